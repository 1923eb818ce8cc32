"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities.  A term near an entity discloses it as far as
it tells which entity it is: the pointwise mutual information of term and entity as a
share of the entity's information,

    1 - log(n(term) / n(term, entity)) / log(N / n(entity)),

with counts over the distinct texts of the whole corpus.  It is 1 for a term that stands nowhere else.  Terms
from a threshold on are removed or, if they disclose less, generalised.

Copies of a context count once, so that a copied document does not make its own words
telling, and so do copies of a text, so that they do not hide a telling term.  Only texts
that a map of a fixed size takes for copies are compared as such.  All counts are sums per key that tasks reduce before they send them; the terms
whose frequency is asked for go to the tasks as a map of a fixed size.

Defined cases: a null text counts as empty; ids may be null or repeat, each row is
scanned; texts of any length are scanned whole; spans of different kinds may overlap and are
listed each, by start and then kind; of equal texts one counts towards a term's frequency;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import bit_map, cut_lineage, id_and_text, map_bits, named, row_base, slices, texts_of
from spanforge.llm.components import salted_join

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "term"]
TERM = len(BASE)
#: Characters on each side of an entity whose words are its context.
REACH = 120
#: Contexts that a term must share with an entity, and the shares of its information from which it goes.
SUPPORT, GENERALISE, REMOVE = 3, 0.75, 0.9

_LOCAL = "".join(map(chr, range(128))).translate({i: None for i in range(128) if not re.match(r"[A-Za-z0-9._%+-]", chr(i))})
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a longer run of digits that is no address is none from within either
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """What the pattern finds leftmost, by the at signs: one has no other before it in its local part."""
    last = 0
    for m in _DOMAIN.finditer(text):
        low = max(last, text.rfind("@", last, m.start()) + 1)
        start = low + len(text[low:m.start()].rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
            last = m.end()


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, normalised value) of the fixed patterns' matches that count."""
    out = []
    if "@" in text:
        out += [(s, 0, e, text[s:e].lower()) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if max(map(_part, m[0].split("."))) <= 255]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = "".join(filter(str.isdigit, m[0]))
                if 10 <= len(digits) <= 15:
                    out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def _part(p: str) -> int:
    """An address part's number, or 256 for all that are too large."""
    p = p.lstrip("0")
    return int(p or 0) if len(p) < 4 else 256


def context(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Whole words within reach on both sides, with their places."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    out = []
    for m in _TERM.finditer(text, low, high):
        s, e = m.span()
        if (e <= start or s >= end) and not (s == low and low and text[low - 1].isalpha()) and not (e == high < len(text) and text[high].isalpha()):
            out.append((m[0].lower(), s, e))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_NEAR = pa.struct([("entity", pa.string()), ("context", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _seal(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _stage(batches):
    row = row_base()
    for batch in slices(batches):
        spans, near, seals = [], [], []
        for text in texts_of(batch.column(1)):
            seals.append(_seal(text))
            found = entities(text)
            spans.append([(s, k, e) for s, k, e, _ in found])
            here, starts, reach = [], [s for s, _, _, _ in found], list(accumulate((e for _, _, e, _ in found), max))
            taken = lambda low, high: (i := bisect_left(starts, high)) > 0 and reach[i - 1] > low  # noqa: E731, B023
            for s, k, e, value in found:
                words = [w for w in context(text, s, e) if not taken(w[1], w[2])]
                seal = xxhash.xxh3_64_intdigest(" ".join(w for w, _, _ in words).encode()) >> 1
                here += [(f"{k}:{value}", seal, *w) for w in words]
            near.append(here)
        n = batch.num_rows
        tuples = lambda values, kind: pa.array([[dict(zip(kind.names, v)) for v in vs] for vs in values], pa.list_(kind))
        yield pa.record_batch([pa.array(np.arange(row, row + n)), batch.column(0), tuples(spans, _SPAN), tuples(near, _NEAR),
                               pa.array(seals, pa.int64())], names=["row", "doc_id", "spans", "near", "seal"])
        row += n


_STAGE = ("row long, doc_id long, spans array<struct<start:long,kind:int,end:long>>, "
          "near array<struct<entity:string,context:long,term:string,start:long,end:long>>, seal long")


def _frequencies(wanted, copied=None):
    """How many texts have a wanted term, and under the empty term how many there are; possible copies come back as texts."""

    def run(batches):
        mask, counts = np.frombuffer(wanted.value, np.uint8), {}
        copies = np.frombuffer(copied.value, np.uint8) if copied else None
        for batch in slices(batches):
            again = []
            for text in texts_of(batch.column(0)):
                if copied:
                    at = _seal(text) % (8 * len(copies))
                    if copies[at >> 3] >> (at & 7) & 1:
                        again.append(text)
                        continue
                counts[""] = counts.get("", 0) + 1
                for term in set(_TERM.findall(text.lower())):
                    at = zlib.crc32(term.encode()) % (8 * len(mask))
                    if mask[at >> 3] >> (at & 7) & 1:
                        counts[term] = counts.get(term, 0) + 1
            if again:
                yield pa.record_batch([pa.nulls(len(again), pa.string()), pa.nulls(len(again), pa.int64()), pa.array(again, pa.string())], names=_COUNTS)
            if len(counts) > 100_000:
                yield _counted(counts)
                counts = {}
        if counts:
            yield _counted(counts)

    return run


_COUNTS = ["term", "n", "text"]


def _counted(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()),
                            pa.nulls(len(counts), pa.string())], names=_COUNTS)


def _filter(hashes: DataFrame) -> bytes:
    """Set bits of the column ``hash``, in a map for as many."""
    size = map_bits(hashes.count())
    return bit_map(hashes.select((F.col("hash") % size).alias("at")), size)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
                       threshold: float = GENERALISE) -> DataFrame:
    """One row per document: row, doc_id, found (start, kind, end, disclosure), by start and kind.

    Kinds are numbered as in KINDS; ``disclosure`` is null but for terms.  Positions are
    code points, ends exclusive.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    stage = cut_lineage(docs.mapInArrow(_stage, _STAGE))
    near = stage.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    joint = (near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
             .where(F.col("n_both") >= support))
    joint = cut_lineage(joint)
    apart = near.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    wanted = spark.sparkContext.broadcast(_filter(joint.select(F.crc32(F.col("term").cast("binary")).alias("hash")).distinct()))
    copied = spark.sparkContext.broadcast(_filter(stage.groupBy(F.col("seal").alias("hash")).count().where("count > 1")))
    counted = cut_lineage(docs.select("text").mapInArrow(_frequencies(wanted, copied), "term string, n long, text string"))
    once = counted.where(F.col("text").isNotNull()).select("text").distinct().mapInArrow(_frequencies(wanted), "term string, n long, text string")
    terms = cut_lineage(counted.where(F.col("text").isNull()).unionByName(once).groupBy("term").agg(F.sum("n").alias("n_term")))
    documents = F.lit(float(max(2, terms.where("term = ''").agg(F.max("n_term")).first()[0] or 0)))
    share = 1 - F.log(F.greatest("n_term", "n_both") / F.col("n_both")) / F.log(F.greatest(documents / F.col("n_entity"), F.lit(2.0)))
    telling = salted_join(salted_join(joint, apart, ["entity"]), terms, ["term"]).select(
        "entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= threshold)
    spans = salted_join(near, cut_lineage(telling), ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(TERM).alias("kind"), "end", "disclosure")).alias("terms"))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                   F.lit(None).cast("double").alias("disclosure")))
    kind = "array<struct<start:bigint,kind:int,end:bigint,disclosure:double>>"
    return stage.select("row", "doc_id", "spans").join(spans, "row", "left").select(
        "row", "doc_id", F.array_sort(F.concat(base.cast(kind), F.coalesce("terms", F.array().cast(kind)).cast(kind))).alias("found"))


def sanitised(text: str, found: list) -> str:
    """The text with entities named by their kind, and telling terms cut to a letter or taken out."""
    out, at = [], 0
    for s, k, e, share in sorted(found):
        if s < at:
            at = max(at, e)
            continue
        out.append(text[at:s])
        out.append(f"[{KINDS[k]}]" if k != TERM else "" if share >= REMOVE else text[s] + "…")
        at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, text) with personal data and the terms that disclose it out of the texts.

    The spans of texts that are equal are equal, but for terms' contexts, so they are
    found and applied by row number, which is written once.
    """
    rows = cut_lineage(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"),
                                   F.monotonically_increasing_id().alias("key")))
    found = find_personal_data(rows, id_col="key", **kw).where(F.size("found") > 0).select(F.col("doc_id").alias("key"), "found")

    def run(batches):
        for batch in slices(batches):
            texts = [t if not f else sanitised(t or "", [tuple(x.values()) for x in f])
                     for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.join(found, "key", "left").select("doc_id", "text", "found").mapInArrow(run, "doc_id long, text string")
