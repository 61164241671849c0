"""Language identification: text likelihood, declared language, address and host priors fused by Bayes' rule."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.llm.common import cut

LETTERS = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", re.S | re.I)


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


class TextModel:
    """Character trigrams of words by language, add-half smoothed."""

    def __init__(self, langs: list[str], counts: dict[str, list[int]]):
        self.langs = langs
        total = np.array([sum(c[k] for c in counts.values()) for k in range(len(langs))], dtype=np.float64)
        wide = len(counts) + 1
        self.unseen = np.log(0.5 / (total + 0.5 * wide))
        self.logp = {g: np.log((np.array(c) + 0.5) / (total + 0.5 * wide)) for g, c in counts.items()}


class Words(dict):
    """Word -> row of a table of log likelihoods; starts anew when full."""

    def __init__(self, model: TextModel, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most
        self.table = np.zeros((most, len(model.langs)))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.table[k] = sum(self.model.logp.get(g, self.model.unseen) for g in trigrams(word))
        return k

    def score(self, text: str) -> tuple[np.ndarray, int]:
        words = LETTERS.findall(text.lower())
        total = np.zeros(len(self.model.langs))
        for c in range(0, len(words), 50_000):
            part = words[c : c + 50_000]
            if len(self) + len(part) > self.most:
                self.clear()
            rows = np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))
            total += self.table[rows].sum(axis=0)
        return total, len(words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w, n in Counter(LETTERS.findall((text or "").lower())).items():
                for g in trigrams(w):
                    counts[lang, g] += n
    rows = [(a, g, n) for (a, g), n in counts.items()]
    cols = list(zip(*rows)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "gram", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = 2000, grams: int = 60_000, most_langs: int = 200) -> TextModel:
    """Fit on about `sample` labelled texts of each of the most_langs commonest languages (those of least hash) and
    the `grams` commonest trigrams; the bounds, for fitting only, keep the driver's share fixed at any size. Raise
    most_langs if the labels have more languages. Null texts and labels are left out; without any label the one
    language is "und"."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return TextModel(["und"], {})
    part = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n))])
    drawn = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))
    sums = drawn.mapInArrow(_count, "lang string, gram string, n long").groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{k}") for k, x in enumerate(langs)], F.sum("n").alias("n"))
    rows = sums.orderBy(F.col("n").desc(), "gram").limit(grams).collect()
    return TextModel(langs, {r["gram"]: [r[f"l{k}"] for k in range(len(langs))] for r in rows})


def _likelihood(model: TextModel, html: bool, temper: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            last = batch.num_columns - 1
            out = []
            for t in batch.column(last):
                text = t.as_py() or ""
                total, n = words.score(MARKUP.sub(" ", text) if html else text)
                out.append((total * min(1.0, temper / max(1, n))).tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(last)], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "text_ll"])

    return run


def _table(df: DataFrame, by: str, langs: int, name: str) -> DataFrame:
    """Counts of the text's own verdict by value of `by`, as an array over languages."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum((F.col("verdict") == k).cast("double")) for k in range(langs)]).alias(name))


def fuse(rows: DataFrame, model: TextModel, strength: float = 5.0) -> DataFrame:
    """Posterior of each row from text_ll and the columns declared, suffix, host and domain (null where unknown).

    The text's verdicts, counted by grouped aggregation over all other rows, tell how far each declared language and
    address suffix goes with each language. A host's prior is smoothed towards its domain's, that towards the
    overall shares, with the weight of `strength` rows each. A row's own verdict is left out of its own counts: its
    text speaks once, through its likelihood.
    """
    n = len(model.langs)
    best = F.array_position(F.col("text_ll"), F.array_max("text_ll")).cast("int") - 1
    rows = cut(rows.withColumn("verdict", best))
    overall = rows.groupBy().agg(*[F.sum((F.col("verdict") == k).cast("double")).alias(f"c{k}") for k in range(n)]).first()
    share = np.array([(overall[k] or 0) + 1.0 for k in range(n)])
    share = share / share.sum()
    base = F.array(*[F.lit(float(x)) for x in share])
    zeros = F.array(*[F.lit(0.0)] * n)
    others = lambda by: lambda x, k: x - F.when(F.col(by).isNotNull() & (k == F.col("verdict")), 1.0).otherwise(0.0)
    out = rows
    for by in ("declared", "suffix", "domain", "host"):
        sums = _table(rows, by, n, f"n_{by}").withColumnRenamed(by, f"_{by}")
        out = out.join(sums, F.col(by) == F.col(f"_{by}"), "left").drop(f"_{by}").withColumn(f"n_{by}", F.transform(F.coalesce(f"n_{by}", zeros), others(by)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    domain = F.zip_with("n_domain", base, lambda x, p: x + strength * p)
    domain = F.transform(domain, lambda x: x / (total(F.col("n_domain")) + strength))
    out = out.withColumn("p_domain", domain)
    host = F.zip_with("n_host", "p_domain", lambda x, p: x + strength * p)
    out = out.withColumn("p_host", F.transform(host, lambda x: x / (total(F.col("n_host")) + strength)))
    logs = F.zip_with("text_ll", "p_host", lambda a, p: a + F.log(p))
    for by in ("declared", "suffix"):  # P(value | language) up to a constant: counts over the language's share, smoothed
        lift = F.zip_with(f"n_{by}", base, lambda x, p: F.log((x + strength * p) / p))
        logs = F.zip_with(logs, F.when(F.col(by).isNull(), zeros).otherwise(lift), lambda a, b: a + b)
    out = out.withColumn("_l", logs).withColumn("_m", F.array_max("_l"))
    out = out.withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.col("_m"))))
    names = F.array(*[F.lit(x) for x in model.langs])
    pick = F.array_position("_l", F.col("_m")).cast("int")
    return out.withColumn("lang", F.element_at(names, pick)).withColumn("posterior", F.lit(1.0) / total(F.col("_e"))).drop("_l", "_m", "_e", "p_host", "p_domain", "n_declared", "n_suffix", "n_domain", "n_host", "verdict", "text_ll")


def host_of(url: Column) -> Column:
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return F.when(h != "", h)


def identify_pages(pages: DataFrame, model: TextModel, html: str = "html", url: str = "url", temper: float = 40.0) -> DataFrame:
    """pages without html, with lang and posterior, and the evidence used: declared, suffix, host, domain.

    Text is the page's without markup, whole; its likelihood counts as that of `temper` words at most. declared is
    the html element's lang attribute (primary subtag), suffix the address's last label, domain the last two labels
    of the host. Null or empty html and url are missing evidence: the priors decide. Ties go to the language first
    in code point order. Repeated rows are treated alike; an empty table gives an empty table; columns of the input
    with the output's names are replaced.
    """
    pages = pages.drop("lang", "posterior", "declared", "suffix", "host", "domain")
    declared = F.lower(F.regexp_extract(F.col(html), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = host_of(F.col(url))
    labels = F.split(host, r"\.")
    # the page's own columns travel as one, so none of their names can clash with those used here
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html])
    rows = pages.select(own.alias("page"), F.when(declared != "", declared).alias("declared"), F.element_at(labels, -1).alias("suffix"), host.alias("host"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), F.col(html).alias("html"))
    kept = T.StructType([rows.schema["page"], *[T.StructField(c, T.StringType()) for c in ("declared", "suffix", "host", "domain")], T.StructField("text_ll", T.ArrayType(T.DoubleType()))])
    return fuse(rows.mapInArrow(_likelihood(model, True, temper), kept), model).select("page.*", "declared", "suffix", "host", "domain", "lang", "posterior")
