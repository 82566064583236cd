"""URL filters by a character language-model ratio (operator 2).

Two variable-order Markov models over the characters of host and path, one of accepted and one
of rejected URLs, are smoothed by interpolating each order with the next shorter one
(Witten-Bell). A URL's measure is the difference of its log-likelihoods divided by its length;
the cut is calibrated on URLs of hosts held out from the counts, so that a stated share of the
accepted ones falls below it. What a character adds follows from it
and the ORDER bytes before it: one gram, held whole in a 64-bit number. The exact counts of all
grams are a written table that grows with the corpus; nothing is hashed or sent to the driver.

Explicit rules on host and path come first; the longest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._links import bounded_batches, checkpointed

#: Longest context, in bytes; it and a character fit in 64 bits.
ORDER = 5
#: The four models: of accepted and rejected URLs, without those held out and of all.
MODELS = ("early_good", "early_bad", "good", "bad")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many hosts, by hash, is held out to calibrate the cut.
HELD = 5

#: Words of host names that mark a URL as rejected where no other labels are given.
SEED_WORDS = ("adult", "ads", "adserver", "bets", "betting", "casino", "escort", "gambling", "pharma", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    return F.coalesce(lower(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class UrlRule:
    """allow or block for a host and its subdomains, where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def rule(verdict: str, text: str) -> UrlRule:
    host, slash, path = text.partition("/")
    return UrlRule(verdict, host, slash + path)


def _text(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each host and path between ORDER zero bytes and an end byte, in one array; where each begins, behind the zeros."""
    raw = [(a.as_py() + b.as_py()).encode() for a, b in zip(host, path, strict=True)]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + ORDER + 1
    buf = np.frombuffer(b"".join(b"\0" * ORDER + x + b"\1" for x in raw), np.uint8)
    return buf, np.r_[0, np.cumsum(size)]


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each character to be foretold (it and the ORDER bytes before it, itself the lowest byte), and its URL."""
    place = np.ones(len(buf), dtype=bool)
    for k in range(ORDER):
        place[off[:-1] + k] = False
    at = np.flatnonzero(place)
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        gram = gram << 8 | buf[at - k]
    return gram, np.searchsorted(off, at, "right") - 1


def gram_counts(urls: DataFrame) -> DataFrame:
    """urls: host, path, rejected, held. gram and how often each of MODELS has it, zeros included."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, url = _grams(*_text(batch.column(0), batch.column(1)))
            label = batch.column(2).cast(pa.int8()).to_numpy() * 2 + batch.column(3).cast(pa.int8()).to_numpy()
            key, n = np.unique(gram << 2 | label[url], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 2), pa.array(key & 2 > 0), pa.array(key & 1 > 0), pa.array(n, pa.int64())], ["gram", "rejected", "held", "n"])

    parts = urls.select("host", "path", "rejected", "held").mapInArrow(act, "gram long, rejected boolean, held boolean, n long")
    which = dict(zip(MODELS, ("not rejected and not held", "rejected and not held", "not rejected", "rejected"), strict=True))
    return parts.groupBy("gram").agg(*(F.sum(F.when(F.expr(x), F.col("n")).otherwise(0)).alias(m) for m, x in which.items()))


def gram_gains(counts: DataFrame) -> DataFrame:
    """gram, early_gain and gain: the difference of the log-probabilities of its character after its context."""
    levels = [counts]
    for order in range(ORDER - 1, -1, -1):
        shorter = levels[0].groupBy(F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("gram")).agg(*(F.sum(m).alias(m) for m in MODELS))
        levels.insert(0, checkpointed(shorter))
    known = None
    for order, pairs in enumerate(levels):
        context = F.shiftright("gram", 8)
        sums = [x for m in MODELS for x in (F.sum(m).alias(f"n_{m}"), F.sum((F.col(m) > 0).cast("long")).alias(f"t_{m}"))]
        both = pairs.withColumn("context", context).join(pairs.groupBy(context.alias("context")).agg(*sums), "context")
        if known is None:
            both = both.select("*", *(F.lit(1 / 256).alias(f"p_{m}") for m in MODELS))
        else:
            both = both.withColumn("short", F.col("gram").bitwiseAND((1 << 8 * order) - 1)).join(known.withColumnRenamed("gram", "short"), "short")
        p = {m: F.when(F.col(f"n_{m}") > 0, (F.col(m) + F.col(f"t_{m}") * F.col(f"p_{m}")) / (F.col(f"n_{m}") + F.col(f"t_{m}"))).otherwise(F.col(f"p_{m}")) for m in MODELS}
        known = checkpointed(both.select("gram", *(x.alias(f"p_{m}") for m, x in p.items())))
    return known.select("gram", (F.log("p_early_good") - F.log("p_early_bad")).alias("early_gain"), (F.log("p_good") - F.log("p_bad")).alias("gain"))


def _measured(urls: DataFrame, gains: DataFrame, count: int, part_rows: int = 20_000) -> DataFrame:
    """urls with early and measure: (log P(accepted) - log P(rejected)) / characters, by either pair of models; 0 for no characters.

    A part of the URLs asks for each of its grams once, so a gram of all URLs makes one row a part.
    """
    names = urls.columns
    dealt = urls.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(max(12, count // part_rows)).cast("long")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, url = _grams(*_text(batch.column(0), batch.column(1)))
            part = batch.column(2).to_numpy()[url]
            order = np.lexsort((gram, part))
            gram, part = gram[order], part[order]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(gram[new])], ["part", "gram"])

    def act(mine: pa.Table, known: pa.Table) -> pa.Table:
        early, full = np.zeros(mine.num_rows), np.zeros(mine.num_rows)
        if mine.num_rows:
            gram, url = _grams(*_text(A.column(mine, "host"), A.column(mine, "path")))
            order = np.argsort(A.column(known, "gram").to_numpy())
            at = order[np.searchsorted(A.column(known, "gram").to_numpy()[order], gram)]
            n = np.bincount(url, minlength=mine.num_rows)
            early, full = (np.where(n > 1, np.bincount(url, weights=A.column(known, x).to_numpy()[at], minlength=len(n)) / n, 0.0) for x in ("early_gain", "gain"))
        return mine.select(names).append_column("early", pa.array(early)).append_column("measure", pa.array(full))

    asked = dealt.select("host", "path", "part").mapInArrow(ask, "part long, gram long").distinct()
    answers = asked.join(gains, "gram").select("part", "gram", "early_gain", "gain")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema), "early double", "measure double"])
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(act, schema)


def listed_host(url: Column) -> Column:
    """Whether a word of the host is one of SEED_WORDS."""
    return F.arrays_overlap(F.split(host_of(url), r"[^a-z]+", -1), F.array(*(F.lit(w) for w in SEED_WORDS)))


def junk_page(html: Column, share: float = 0.05) -> Column:
    """Whether over a share of a page's words carry a run of three or more marks; null pages are none."""
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    words = F.size(F.split(visible, r"\s+", -1))
    return F.coalesce(F.regexp_count(F.regexp_replace(visible, r"&[a-z]+;", "&"), F.lit(r"[%*#$&=|~^]{3,}")) > share * words, F.lit(False))


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = (), rejected: Column | None = None, id_col: str = "page_id", url_col: str = "url", blocked: float = 0.01) -> DataFrame:
    """page_id, host, path, rule, verdict and measure of each row.

    verdict is the longest fitting rule's (rule holds its text, else null); where none fits, it
    is block if the measure is below the cut, else allow. rejected: which rows train the model
    of rejected URLs, by default those that listed_host marks; the others train the other one,
    but for rows where it is null, which are only judged. The cut is where a share `blocked` of the accepted URLs of held-out hosts lies
    below. Null URLs and those without :// have empty host and path and are allowed; so are all
    where no URL, or every one, is rejected in training, or no accepted host is held out.
    Repeated rows are judged each. Other columns are ignored, whatever their names, but by
    `rejected`. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    url = F.col(url_col).cast("string")
    label = rejected if rejected is not None else F.coalesce(listed_host(url), F.lit(False))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), label.alias("rejected"))
    urls = urls.withColumn("held", F.pmod(F.xxhash64("host"), F.lit(HELD)) == 0)
    urls = checkpointed(urls)
    some = urls.where("host <> '' or path <> ''")
    taught = some.where(F.col("rejected").isNotNull())
    if taught.select("rejected").distinct().count() == 2:
        grams = gram_counts(taught)
        if some.where(F.col("rejected").isNull()).limit(1).count():
            # grams of the others, which no model counts
            rest = gram_counts(some.where(F.col("rejected").isNull()).withColumn("rejected", F.lit(False)))
            grams = grams.unionByName(rest.select("gram", *(F.lit(0).cast("long").alias(m) for m in MODELS))).groupBy("gram").agg(*(F.sum(m).alias(m) for m in MODELS))
        scored = checkpointed(_measured(some, gram_gains(checkpointed(grams)), some.count()))
        edge = scored.where("held and not rejected").agg(F.percentile_approx("early", blocked, 10_000)).first()[0]
        cut = float("-inf") if edge is None else edge
        scored = scored.drop("early").unionByName(urls.where("host = '' and path = ''").withColumn("measure", F.lit(0.0)))
    else:
        cut, scored = float("-inf"), urls.withColumn("measure", F.lit(0.0))
    named, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        named, said = F.when(fits, F.lit(r.name)).otherwise(named), F.when(fits, F.lit(r.verdict)).otherwise(said)
    empty = (F.col("host") == "") & (F.col("path") == "")
    own = F.when(~empty & (F.col("measure") < cut), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", named.alias("rule"), F.coalesce(said, own).alias("verdict"), "measure")
