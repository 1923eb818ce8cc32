"""Secret scan: fixed patterns, and character Markov models for the secrets without one.

Two models of which character follows which are trained from labelled samples, one of
random strings and one of ordinary identifiers.  A run of token characters is a secret
if the log-likelihood ratio of the two models over its characters is high enough.

All of it is column expressions.  A text is read once; what stays of it are its matches
and the lengths of the gaps between them, one row per match from there on, so positions
are running sums and a text with very many matches is no special case.  Only counts of
character pairs (at most 2 x 68 x 68) pass through the driver.

Defined cases: a null text counts as empty; ids may be null or repeat, each row is
scanned; texts and runs of any length are scanned whole; of a random run and a fixed
pattern's match that overlap the match stays; a table without labelled samples is scored
by a uniform model against the smoothed other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.llm.common import cut_lineage, id_and_text

#: Patterns whose matches count, each with the shortest match (for assign: of its second group).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough starts and ends where the longest run does, so the least length is part of
#: the last two patterns; of assign a short match takes up text and so may not be skipped.
BASE = {"assign": (ASSIGN, 6), "access": (r"AKIA[A-Z0-9]{16,}", 20), "hex": (r"[0-9a-f]{24,}", 24)}
KINDS = [*BASE, "random"]
RANDOM = len(BASE)
#: Runs that the models score; shorter ones carry too little evidence.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"
#: The ratio, in nats, from which a run counts as random, in all and per distinct pair of characters.
LEAST, LEAST_EACH = 12.0, 0.5
#: Expected number of documents whose words are the samples of ordinary identifiers.
SAMPLE_DOCS = 2000
SMOOTH, BACK_OFF = 0.5, 20.0
#: Share of the random model that is even over the alphabet, as a random string may have another one than those labelled.
EVEN = 0.5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Code 0 stands for any other character.
CODES = len(ALPHABET) + 1


def _runs(text: Column, pattern: str, kind: int) -> Column:
    """Matches in order, each with the length of the gap before it."""
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, m: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), m.alias("m")))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["m"].isNotNull())).otherwise(F.array().cast(
        "array<struct<kind:int,gap:int,m:string>>"))


def _codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(token: Column) -> Column:
    """One number for each two characters that follow each other."""
    codes = _codes(token)
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * CODES + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, from (token, secret) samples."""
    counts = [[[0] * CODES for _ in range(CODES)] for _ in range(2)]
    pairs = samples.select("secret", F.explode(_pairs(F.col("token"))).alias("pair"))
    for secret, pair, n in pairs.groupBy("secret", "pair").count().collect():
        counts[bool(secret)][pair // CODES][pair % CODES] = n
    logs = []
    for model, even in zip(counts, (0.0, EVEN)):  # pairs back off to how often their second character is seen at all
        single = [sum(row[b] for row in model) for b in range(CODES)]
        single = [even / CODES + (1 - even) * (n + SMOOTH) / (sum(single) + SMOOTH * CODES) for n in single]
        rows = []
        for row in model:
            seen = [(n + BACK_OFF * single[b]) / (sum(row) + BACK_OFF) for b, n in enumerate(row)]
            rows.append([math.log((1 - even) * p + even / CODES) for p in seen])
        logs.append(rows)
    return [r - o for ordinary, random in zip(*logs) for o, r in zip(ordinary, random)]


def random_score(pairs: Column, model: list[float]) -> Column:
    """The ratio summed over a token's distinct pairs, so that mere repetition is no evidence."""
    table = F.from_json(F.lit(json.dumps([round(x, 3) for x in model])), "array<double>")
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.get(table, p), F.lit(0.0)))


def _base_matches(found: DataFrame) -> DataFrame:
    """Matches of the fixed patterns that are long enough, with the secret itself."""
    value = F.when(F.col("kind") == 0, F.regexp_extract("m", ASSIGN, 2)).otherwise(F.col("m"))
    least = F.get(F.array(*(F.lit(n) for _, n in BASE.values())), F.col("kind"))
    return found.where(F.col("kind") < RANDOM).withColumn("value", value).where(F.length("value") >= least)


def _is_random(pairs: Column, score: Column, least: float, least_each: float) -> Column:
    return (score >= least) & (score >= least_each * F.size(pairs))


def labelled_samples(docs: DataFrame, matches: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token, secret): all matched secrets against the words that about ``sample_docs`` distinct texts share.

    Texts are drawn by their hash, so any partitioning draws the same.  A word is ordinary
    if two of the texts have it: random strings, also those that no pattern matches, do not
    recur.  Words within matched secrets are cut out of the sample by the same patterns.
    """
    # copies of one text count as one
    texts = F.approx_count_distinct(F.xxhash64("text"), 0.02)
    share = min(1.0, sample_docs / max(docs.agg(texts.alias("n")).first().n, 1))
    rest = F.col("text")
    for pattern, _ in BASE.values():
        rest = F.regexp_replace(rest, pattern, " ")
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").distinct()
    words = (drawn.select(F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)))).alias("token"))
             .where(F.col("token").rlike("[A-Za-z]")).groupBy("token").count().where("count > 1").select("token"))
    return _base_matches(matches).select(F.col("value").alias("token"), F.lit(True).alias("secret")).unionByName(
        words.withColumn("secret", F.lit(False)))


def self_trained(samples: DataFrame, *, least: float = LEAST, least_each: float = LEAST_EACH) -> list[float]:
    """The model of the samples, without the ordinary ones that the first model of them all takes for random."""
    samples = cut_lineage(samples)
    pairs = F.array_distinct(_pairs(F.col("token")))
    first = random_score(pairs, train(samples))
    return train(samples.where(F.col("secret") | ~_is_random(pairs, first, least, least_each)))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None,
                 least: float = LEAST, least_each: float = LEAST_EACH) -> DataFrame:
    """One row per document: row, doc_id, secrets (start, kind, end, score), by start and kind.

    ``samples`` (token, secret) trains the models; without it the documents' own
    matches and words do.  Positions are code points, ends exclusive.  A random run
    that overlaps a fixed pattern's match is left out.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    runs = F.concat(*(_runs(text, p, k) for k, p in enumerate([*(p for p, _ in BASE.values()), TOKEN])))
    # short matches stay, as they are consumed text; only their lengths matter
    stage = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", runs.alias("runs")))
    found = stage.where(F.size("runs") > 0).select("row", F.posexplode("runs").alias("pos", "x")).select("row", "pos", "x.*")
    model = train(samples) if samples is not None else self_trained(labelled_samples(docs, found), least=least, least_each=least_each)
    in_text = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("m")
    placed = found.withColumn("end", F.sum(F.col("gap") + size).over(in_text)).withColumn("start", F.col("end") - size)
    base = _base_matches(placed).select("row", "start", "kind", "end", F.lit(None).cast("double").alias("score"))
    # both sides of the comparison count distinct pairs, whose number the alphabet bounds
    chance = (placed.where((F.col("kind") == RANDOM) & F.col("m").rlike("[A-Za-z]"))
              .withColumn("pairs", F.array_distinct(_pairs(F.col("m")))).withColumn("score", random_score(F.col("pairs"), model))
              .where(_is_random(F.col("pairs"), F.col("score"), least, least_each))
              .select("row", "start", "kind", "end", "score"))
    order = Window.partitionBy("row").orderBy("start", "kind")
    fixed = F.col("kind") < RANDOM
    reach = F.max(F.when(fixed, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(fixed, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = ~F.coalesce(reach > F.col("start"), F.lit(False)) & ~F.coalesce(ahead < F.col("end"), F.lit(False))
    spans = (base.unionByName(chance).withColumn("_free", free).where(fixed | F.col("_free")).groupBy("row")
             .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "score"))).alias("secrets")))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>")
    return stage.select("row", "doc_id").join(spans, "row", "left").withColumn("secrets", F.coalesce("secrets", empty))


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
