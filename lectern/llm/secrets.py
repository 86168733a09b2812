"""Secret scans with corpus-wide ownership frequency.

Fixed patterns give the base spans (assignments, access keys, hex runs), which always stay.
Generators propose more: private-key blocks, bearer and URL credentials, known token
prefixes, long mixed runs.  Each candidate's value is hashed, and over the whole corpus the
distinct owners and repositories of each hash are counted: values that many owners share, or
that many repositories of few owners hold, are copied examples; values of one owner that look
random are live-looking credentials.  Only
live-looking proposals become added spans; base spans get a verdict beside them.

Counting goes in two steps, each combined before its shuffle: distinct (hash, owner,
repository), then one row for each hash.  A value in a third of all documents is a few rows,
and its spans meet its verdict in SALTS tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

KINDS = ("assign", "access", "hex", "block", "bearer", "url", "prefix", "random")
BASE = KINDS[:3]
#: owners from which a value counts as a widely copied example
WIDELY = 3
#: repositories from which it does, whoever owns them: twice as many, as one owner may use a credential in several
SPREAD = 2 * WIDELY
#: bits a character, over the value's own characters, from which it looks random
RANDOM_BITS = 3.0
#: tasks among which the spans of one copied value are dealt
SALTS = 32

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_MARK = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
_URL = re.compile(r"://[^\s:/@]+:([^\s:/@]{6,})@")
_SCHEME = "abcdefghijklmnopqrstuvwxyz0123456789+.-"
_FIRST = re.compile(r"\b[a-z](?=[a-z0-9+.-])")
_TOKEN_RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++")
_JSON_START = re.compile(r"\beyJ")


def _blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """From each BEGIN line to the next END line, whatever is between (headers, escaped line ends)."""
    start = None
    for m in _MARK.finditer(text):
        if m.group(1) == "BEGIN":
            start = m
        elif start is not None:
            if m.start() - start.end() >= 40:
                yield start.start(), m.end(), text[start.start() : m.end()]
            start = None


def _urls(text: str) -> Iterator[tuple[int, int, str]]:
    """Passwords in URLs, from the scheme to the @; schemes are read backwards from ://."""
    last = 0
    for m in _URL.finditer(text):
        run = m.start()
        while run > last and text[run - 1] in _SCHEME:
            run -= 1
        if (first := _FIRST.search(text, run, m.start())) is not None:
            yield first.start(), m.end(), m.group(1)
        last = m.end()


def _web_tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Three parts of ten characters or more between points, the first from eyJ on; each part is looked at once."""
    for run in _TOKEN_RUN.finditer(text):
        parts = run.group().split(".")
        at, i = run.start(), 0
        while i < len(parts) - 2:
            begin = _JSON_START.search(parts[i])
            if begin and len(parts[i]) - begin.end() >= 10 and len(parts[i + 1]) >= 10 and len(parts[i + 2]) >= 10:
                start, end = at + begin.start(), at + sum(map(len, parts[i : i + 3])) + 2
                yield start, end, text[start:end]
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1


def _matches(pattern: str, group: int = 0) -> Callable[[str], Iterator[tuple[int, int, str]]]:
    compiled = re.compile(pattern)
    return lambda text: ((*m.span(), m.group(group)) for m in compiled.finditer(text))


# no upper bounds: a span is the whole value, so redaction and the owners' count are of all of it
_PROPOSED: tuple[tuple[str, Callable[[str], Iterator[tuple[int, int, str]]], tuple[str, ...]], ...] = (
    ("block", _blocks, ("-----BEGIN",)),
    ("bearer", _matches(r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)", 1), ("earer ",)),
    ("url", _urls, ("://",)),
    ("prefix", _matches(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})"), ("gh", "xox", "sk_live_", "AIza")),
    ("prefix", _web_tokens, ("eyJ",)),
    ("random", _matches(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"), ()),
)

Found = tuple[str, int, int, str]  # kind, start, end, value


def base_found(text: str) -> list[Found]:
    """Leftmost non-overlapping matches of each fixed pattern; failing ones are dropped, not retried."""
    out = [("assign", *m.span(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span(), m.group()) for m in _ACCESS.finditer(text) if len(m.group()) >= 18]
    return out + [("hex", *m.span(), m.group()) for m in _HEX.finditer(text)]


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def covered(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places that ``spans`` cover, as disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def proposed(text: str, taken: list[Found]) -> list[Found]:
    """Random-looking values that no base span overlaps; earlier generators win over later ones.

    Each generator's matches come in order and are held against the intervals taken so far in
    one sweep, so the work is linear in the text but for sorting.
    """
    out: list[Found] = []
    busy = covered((a, b) for _, a, b, _ in taken)
    for kind, find, needs in _PROPOSED:
        if needs and not any(x in text for x in needs):
            continue
        k, new = 0, []
        for start, end, value in find(text):
            while k < len(busy) and busy[k][1] <= start:
                k += 1
            if k < len(busy) and busy[k][0] < end:
                continue
            mixed = kind != "random" or (any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value))
            if mixed and bits_per_character(value) >= RANDOM_BITS:
                new.append((kind, start, end, value))
        if new:
            out += new
            busy = covered([*busy, *((a, b) for _, a, b, _ in new)])
    return out


def in_order(found: list) -> list:
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def value_hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - 2**63


def scan(documents: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """doc_id, owner, repository and spans (kind, start, end, value hash, base) of each row; values stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for text in batch["text"].to_pylist():
                base = base_found(text or "")
                own = [(s, True) for s in base] + [(s, False) for s in proposed(text or "", base)]
                every.append([{"kind": k, "start": a, "end": b, "value": value_hash(v), "base": is_base} for (k, a, b, v), is_base in own])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["owner"], batch["repository"], pa.array(every, kind)], ["doc_id", "owner", "repository", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("base", pa.bool_())]))
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in documents.columns else F.lit("")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), of(owner).alias("owner"), of(repository).alias("repository"), "text")
    return rows.mapInArrow(run, "doc_id long, owner string, repository string, spans array<struct<kind:string,start:long,end:long,value:long,base:boolean>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """value, owners, repositories (distinct pairs of owner and repository) of every candidate value."""
    pairs = scanned.select("owner", "repository", F.explode("spans.value").alias("value")).groupBy("value", "owner", "repository").agg(F.lit(1))
    by_owner = pairs.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(documents: DataFrame, owner: str = "source", repository: str = "lang", widely: int = WIDELY, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for each row of ``documents``.

    Counts and base_sha256 are of the base spans; spans lists base spans and the added ones as
    kind:start:end (code points, end exclusive).  n_example: spans of values with at least
    ``widely`` owners or ``spread`` repositories; n_live: the other base spans and the added ones.  ``repository`` names a
    repository within its owner.  A null or missing owner or repository is the empty one; a
    null text is empty.  Rows that repeat a doc_id are read each; empty tables are fine.
    """
    scanned = materialise(scan(documents, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    shared = materialise(ownership(scanned).where((F.col("owners") >= widely) | (F.col("repositories") >= spread)).select(F.col("value").alias("copied")))
    # a value copied into a third of all documents is no single key: its spans are dealt by row, its verdict is repeated
    dealt = shared.select("copied", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spans = scanned.select("row", F.explode("spans").alias("s")).select("row", "s.*").withColumn("of", F.pmod("row", F.lit(SALTS)).cast("int"))
    judged = spans.join(dealt, (F.col("value") == F.col("copied")) & (F.col("of") == F.col("salt")), "left").withColumn("example", F.col("copied").isNotNull())
    listed = F.struct("start", F.expr("case " + " ".join(f"when kind = '{k}' then {i}" for i, k in enumerate(KINDS)) + " end").alias("k"), "end", "kind", "base", "example")
    by_row = judged.groupBy(F.col("row").alias("r")).agg(F.sort_array(F.collect_list(listed)).alias("all"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = scanned.select("doc_id", "row").join(by_row, F.col("row") == F.col("r"), "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,k:int,end:bigint,kind:string,base:boolean,example:boolean>>")))
    base = F.filter("all", lambda s: s["base"])
    stay = F.filter("all", lambda s: s["base"] | ~s["example"])
    n = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *map(n, BASE), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(stay).alias("spans"),
        F.size(F.filter("all", lambda s: ~s["example"])).cast("long").alias("n_live"), F.size(F.filter("all", lambda s: s["example"])).cast("long").alias("n_example"),
    )


def digest(spans) -> str:
    """What ``base_sha256`` holds for these spans."""
    return hashlib.sha256(written(in_order(list(spans))).encode()).hexdigest()
