"""Language identification by Bayesian evidence fusion.

The posterior of a text's language takes up four kinds of evidence: the likelihood of its byte trigrams, the
language its markup declares, the suffix of its address, and a prior of its host that is smoothed towards
its domain's and that towards the whole table's. What declarations and suffixes are worth, and the priors, come from
grouped sums over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from expirylens.llm.common import extended, materialise

BUCKETS = 1 << 16
# A trigram's log likelihood counts by this factor, as the trigrams of a text depend on each other.
TEMPER = 0.15
# Pseudo-counts: of a host's prior from its domain, of a domain's from the table, of a declaration's and a suffix's table.
HOST_WEIGHT, DOMAIN_WEIGHT, CHANNEL_WEIGHT = 5.0, 20.0, 1.0
MOST_DOCS = 20_000
MOST_LANGUAGES = 200

_HTML_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.IGNORECASE)


def trigrams(text: str) -> np.ndarray:
    """Buckets of all byte trigrams of the lower-cased text, digits as one sign, with a blank at both ends."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8)
    b = np.where((b >= 48) & (b <= 57), 48, b).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.int64)


def fit_text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   most_docs: int = MOST_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of BUCKETS trigrams by language), from at most about ``most_docs`` labelled texts.

    A hash of the id picks them where there are more; they are counted whole, and in tasks first. The driver gets one
    row for each language and bucket. Null labels teach nothing.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    draw = F.crc32(F.concat(F.lit("language "), F.coalesce(F.col(id_col).cast("string"), F.lit("")))) / float(1 << 32)
    sample = known.filter(draw < F.lit(min(1.0, most_docs / max(n, 1)))).select(F.lower(lang_col).alias("lang"), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[lang] = total.get(lang, 0) + np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["lang", "bucket", "n"])

    counts = materialise(sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the labels")
    model = np.full((BUCKETS, max(1, len(names))), 0.5)
    for r in counts.toLocalIterator():
        model[r.bucket, names.index(r.lang)] += r.n
    return names, np.log(model / model.sum(0)).astype(np.float32)


def declared_language(html: str) -> str | None:
    """The primary subtag of the page's lang attribute."""
    m = _HTML_LANG.search(html)
    return m[1].lower() if m else None


def page_rows(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` columns, text, declared, host, domain, suffix of each page; the text is the page's main text."""
    from expirylens.llm.html_extraction import main_text

    rows = pages.select(*keep, url_col, html_col)
    at = len(keep)
    schema = extended(pages.select(*keep).schema, "address string, text string, declared string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [p or "" for p in batch.column(at + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], batch.column(at), pa.array([main_text(p)[0] for p in pages], pa.string()),
                                              pa.array([declared_language(p) for p in pages], pa.string())], [*keep, "address", "text", "declared"])

    host = F.lower(F.regexp_extract("address", r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return rows.mapInArrow(run, schema).withColumn("host", host).withColumns({
        "domain": F.when(F.col("host").isNotNull(), F.regexp_extract("host", r"([^.]+\.[^.]+)$|^(.+)$", 0)),
        "suffix": F.when(F.col("host").rlike(r"\.[a-z]{2,}$"), F.regexp_extract("host", r"\.([a-z]{2,})$", 1))}).drop("address")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns, text_lang, lang, confidence for every row.

    ``rows`` have text, declared, host, domain, suffix, each of which may be null: missing evidence says
    nothing. text_lang is the text's own best language (null without trigrams), lang the fused one, confidence its
    posterior. Ties go to the first name in order. A row's own text is taken out of its host's sums before they
    speak for it. Without any language to choose from, lang is null. An empty table gives no rows;
    repeated rows are rows of their own.

    Sums by host, domain, declaration and suffix are pre-aggregated on the map side, and joined back as one row for
    each value, so a hot host is an ordinary join key that can be split.
    """
    names, table = model
    if not names:
        return rows.select(*keep, F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    size, evidence = len(names), ["declared", "host", "domain", "suffix"]
    first = rows.select(*keep, *evidence, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = np.zeros((batch.num_rows, size))
            seen = []
            for i, text in enumerate(batch.column(len(keep) + 4)):
                h = trigrams(text.as_py() or "")
                seen.append(bool(len(h)))
                for at in range(0, len(h), 1 << 16):
                    logs[i] += table[h[at:at + (1 << 16)]].sum(0, dtype=np.float64)
            logs *= TEMPER
            logs -= logs.max(1, keepdims=True) if batch.num_rows else 0
            own = np.exp(logs)
            own /= own.sum(1, keepdims=True)
            own[~np.array(seen, bool)] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(logs), pa.list_(pa.float64())), pa.array(list(own), pa.list_(pa.float64())), pa.array(seen)],
                                             [*keep, *evidence, "logs", "own", "seen"])

    schema = extended(first.drop("text").schema, "logs array<double>, own array<double>, seen boolean")
    stored = materialise(first.mapInArrow(run, schema))
    one = [F.col("own")[i] for i in range(size)]

    def sums(column: str) -> DataFrame:
        return stored.filter(F.col(column).isNotNull()).groupBy(column).agg(F.array(*[F.sum(c) for c in one]).alias(f"{column}_sum"))

    total = stored.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in one]).first()
    base = np.array(total, float) + 1
    base /= base.sum()
    joined = stored
    for column in evidence:
        joined = joined.join(sums(column), column, "left")

    def less_own(column: str, i: int) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.col(f"{column}_sum")[i], F.lit(0.0)) - F.when(F.col(column).isNotNull(), F.col("own")[i]).otherwise(0.0))

    def whole(column: str) -> Column:
        return sum((less_own(column, i) for i in range(1, size)), less_own(column, 0))

    for column in ("host", "domain"):
        joined = joined.withColumn(f"{column}_n", F.array(*[less_own(column, i) for i in range(size)])).withColumn(f"{column}_all", whole(column))
    joined = joined.withColumn("domain_p", F.array(*[(F.col("domain_n")[i] + DOMAIN_WEIGHT * float(base[i])) / (F.col("domain_all") + DOMAIN_WEIGHT) for i in range(size)]))
    joined = joined.withColumn("prior", F.array(*[F.log((F.col("host_n")[i] + HOST_WEIGHT * F.col("domain_p")[i]) / (F.col("host_all") + HOST_WEIGHT)) for i in range(size)]))

    def channel(column: str, i: int) -> Column:
        """log P(value | language) up to what all languages share: the value's sums over the language's share of the table."""
        mean = F.lit(CHANNEL_WEIGHT) * float(base[i])
        return F.when(F.col(column).isNotNull(), F.log((less_own(column, i) + mean) / float(base[i]))).otherwise(0.0)

    joined = joined.withColumn("posterior", F.array(*[
        F.col("logs")[i] + F.col("prior")[i] + channel("declared", i) + channel("suffix", i) for i in range(size)]))
    languages = F.array(*[F.lit(n) for n in names])
    best = F.array_max("posterior")

    def name(column: str, top: Column) -> Column:
        return F.element_at(languages, F.array_position(F.col(column), top).cast("int"))

    return joined.select(
        *keep, F.when(F.col("seen"), name("logs", F.array_max("logs"))).alias("text_lang"), name("posterior", best).alias("lang"),
        (1 / F.aggregate("posterior", F.lit(0.0), lambda a, x: a + F.exp(x - best))).alias("confidence"))
