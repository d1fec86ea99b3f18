"""Personal data by bootstrapped contextual extraction.

Base spans follow fixed expressions for four kinds. One pass over the texts gives these, and beside them every
identifier-like token with the context it stands in: the word and the punctuation before it and the class of the
character after it. Base spans and long hexadecimal strings are seeds. On the graph of contexts (patterns) and
tokens (instances) Spark then scores in rounds:

    confidence(pattern, kind) = sum of score(instance, kind) over its instances / number of its instances
    score(instance, kind)     = 1 for seeds, else 1 - product of (1 - confidence) over its patterns

Patterns of little mass or confidence are dropped in each round. What stands in a pattern that is left in the end,
and has the form of the kind, is a found identifier; base spans always stay. Only contexts and digests of instances
are shuffled, never texts.

Null text is empty. Rows are told apart by position, so repeated rows and null ids give rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .words import small_batches, table, texts_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MASS, CONFIDENCE = 3, 4.0, 0.7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[A-Za-z0-9_+/=-]+")
BEFORE = re.compile(r"([^\W\d_]{0,24})([^\w\n]{0,6})$")
HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @ in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def context(text: str, start: int, end: int) -> str:
    """The lexical pattern around a span."""
    m = BEFORE.search(text[max(0, start - 32) : start])
    after = text[end : end + 1]
    kind = "$" if not after else "a" if after.isalnum() else " " if after.isspace() else after
    return f"{m[1].lower()}|{' '.join(m[2].split()) if m[2].strip() else m[2][:1]}|{kind}"


def form(token: str) -> str | None:
    """The kind that a token which is no base span has the form of: all that a pattern may make of it."""
    digits = sum(map(str.isdigit, token))
    if len(token) >= 16 and digits and digits < len(token) and any(c.isalpha() for c in token):
        return "secret"
    if token.isdigit():
        return "card" if 12 <= digits <= 19 else "phone" if 7 <= digits <= 11 else None
    return None


def digest(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.casefold().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def occurrences(text: str, base: list[Span]) -> list[tuple[str, int, str, bool, int, int]]:
    """(pattern, instance, kind, seed, start, end) of base spans and of identifier-like tokens beside them."""
    out = [(context(text, s, e), digest(text[s:e]), k, True, s, e) for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    done, i = 0, 0
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "_+/=-"):
            start -= 1
        done = end = TOKEN.match(text, start).end()
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if end - start < 7 or i < len(taken) and taken[i][0] < end:
            continue
        token = text[start:end]
        kind = form(token)
        if kind:
            out.append((context(text, start, end), digest(token), kind, bool(HEX.fullmatch(token)), start, end))
    return out


PASS = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<pattern:string,instance:bigint,kind:string,seed:boolean,s:int,e:int>>"
FOUND = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.int64()), ("kind", pa.string()), ("seed", pa.bool_()), ("s", pa.int32()), ("e", pa.int32())]))


def first_pass(docs: DataFrame) -> DataFrame:
    """Base spans and occurrences of each text; the text itself stays behind."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, found = [], []
            for text in (t or "" for t in b.column("text").to_pylist()):
                spans = base_spans(text)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(x[2] == kind for x in spans))
                base.append(written(spans))
                found.append([dict(zip(("pattern", "instance", "kind", "seed", "s", "e"), o, strict=True)) for o in occurrences(text, spans)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(found, FOUND)], names=["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])

    return texts_of(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, PASS)


def patterns(edges: DataFrame, rounds: int = ROUNDS, mass: float = MASS, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) after the given rounds over distinct (pattern, instance, kind, seed)."""
    degree = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    seeds = edges.filter("seed").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    scores = seeds
    for r in range(rounds):
        weighed = edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        best = weighed.join(degree, "pattern").withColumn("confidence", F.col("mass") / F.col("n")).filter((F.col("mass") >= mass) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence")
        if r + 1 < rounds:
            raised = edges.filter("not seed").join(best, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
            scores = seeds.unionByName(raised).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    return best


def extract(docs: DataFrame) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans, and a hash of the text they belong to."""
    scanned = stored(first_pass(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    each = scanned.select("row", F.explode("found").alias("o")).select("row", "o.*")
    edges = stored(each.select("pattern", "instance", "kind", "seed").distinct(), "pii-graph")
    learned = each.filter("not seed or kind not in ('email', 'ip', 'card', 'phone')").join(patterns(edges), ["pattern", "kind"])
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    more = learned.groupBy("row").agg(F.collect_list(F.struct(F.col("s"), F.when(rank == 0, len(KINDS) + 1).otherwise(rank).alias("k"), F.col("e"), F.col("kind").alias("name"))).alias("more"))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.split(x, ":")[0]).cast("int").alias("k"), F.split(x, ":")[2].cast("int").alias("e"), F.split(x, ":")[0].alias("name")))
    every = F.array_distinct(F.sort_array(F.concat(base, F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int,name:string>>")))))
    joined = scanned.drop("found").join(more, "row", "left")
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["name"], x["s"], x["e"])), ",").alias("spans"), "text_hash")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span, overlapping ones merged, replaced by its kind in angle brackets; n_chars follows the new text."""
    found = extract(docs).filter("spans != ''").groupBy(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.max("spans").alias("__spans"))
    given = docs.withColumn("__id", F.coalesce(docs["doc_id"].cast("long"), F.lit(-1))).withColumn("__hash", F.xxhash64(docs["text"].cast("string")))
    joined = given.join(found, ["__id", "__hash"], "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__spans")
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), strict=True):
                if t and spans:
                    parts, at = [], 0
                    for k, s, e in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))):
                        if s >= at:
                            parts += [t[at:s], f"<{k.upper()}>"]
                        at = max(at, e)
                    t = "".join([*parts, t[at:]])
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if n == "text" else pa.array([None if t is None else len(t) for t in texts], b.schema.field(n).type) if n == "n_chars" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents")).drop("text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: all documents, with personal data replaced."""
    return redact(docs)
