"""Personal data: candidate spans scored by boosted trees.

Fixed patterns give the base spans (e-mail, IP, card, phone), which always stay.  Generators
with high recall propose more spans, which may overlap: spelled-out e-mail addresses, IPv6
addresses (full and compressed), card numbers with other separators, phone numbers without
a plus sign.  Boosted
trees score format and context features of every candidate; they are trained on sentences
made from templates (personal data against order numbers, versions, amounts, dates and
other look-alikes), calibrated on held-out sentences, and each kind's threshold is the
lowest of a half or more with the wanted precision there.  Of overlapping candidates the best score wins.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, lowest_threshold

KINDS = ("email", "ip", "card", "phone")
#: held-out precision of what is added, which sets each kind's threshold
PRECISION = 0.98

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of LOCAL+@DOMAIN, from one @ to the next: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        # the run before an @ holds no other @, so the part after the last one is enough
        part = text[max(end, text.rfind("@", 0, at) + 1) : at]
        start = at - (len(part) - len(part.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by start, then kind as listed."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and m.end() - m.start() <= 37 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- candidates -----------------------------------------------------------------------

# Runs are taken whole and never given back (possessive), and start where no run goes on before
# them, so each is read once by each pattern: no bound on lengths is needed.
_RUN, _LABEL = r"(?<![\w.+-])[\w.+-]++", r"[\w-]++"
_AT = r"(?: ?[\[({<*] ?(?:at|AT|At|@|＠) ?[\])}>*] ?| (?:at|AT|-at-|_at_) | ?[@＠] ?)"
_DOT = r"(?: ?[\[({<*] ?(?:dot|DOT|Dot|\.) ?[\])}>*] ?| (?:dot|DOT|\.|-dot-|_dot_) )"
_GAP = r"[\x20\xa0./‐-–-]"
_NO_NUMBER_BEFORE, _NO_NUMBER_AFTER = r"(?<![\w+.,$€£#/-])", r"(?![0-9]|[.,:/-][0-9])"
#: several patterns of a kind propose alternatives, which may overlap; then what a text must hold
_GENERATORS: tuple[tuple[str, re.Pattern[str], str], ...] = tuple(
    (kind, re.compile(pattern), needs)
    for kind, pattern, needs in (
        ("email", rf"{_RUN}{_AT}{_LABEL}(?:{_DOT}{_LABEL})++", "at"),
        ("email", rf"{_RUN}{_AT}{_LABEL}(?:\.{_LABEL})++", "at"),
        ("email", rf"{_RUN}{_AT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})++", "at"),
        ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
        ("ip", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:])", "::"),
        ("ip", r"(?<![\w.\]])[0-9]{1,3}(?:(?: ?[\[({] ?(?:\.|dot) ?[\])}] ?| \. | dot )[0-9]{1,3}){3}(?!\w)", "0"),
        ("card", r"(?<![0-9])[0-9]{4}([./_\xa0‐-–])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])", "0"),
        ("card", r"(?<![0-9])[0-9]{4}([./_\xa0‐-–])[0-9]{6}\1[0-9]{5}(?![0-9])", "0"),
        ("phone", rf"{_NO_NUMBER_BEFORE}(?:\([0-9]{{2,5}}\)|00[0-9]{{1,3}}|[0-9]{{2,5}})(?:{_GAP}{{1,2}}[0-9]{{2,8}}){{1,5}}{_NO_NUMBER_AFTER}", "0"),
        ("phone", rf"{_NO_NUMBER_BEFORE}(?:1{_GAP})?\([0-9]{{1,5}}\) ?[0-9]{{2,6}}(?:{_GAP}{{1,2}}[0-9]{{2,6}}){{1,4}}{_NO_NUMBER_AFTER}", "("),
        ("phone", rf"{_NO_NUMBER_BEFORE}1{_GAP}[0-9]{{3}}{_GAP}[0-9]{{3}}{_GAP}[0-9]{{4}}{_NO_NUMBER_AFTER}", "0"),
        ("phone", rf"{_NO_NUMBER_BEFORE}[0-9]{{9,12}}(?!\w|[.,:/-][0-9])", "0"),
    )
)
#: "at" in brackets, or as a word with a dot near it in some form
_AT_WORD = re.compile(r"[\[({<*] ?at\b|\bat ?[\])}>*]| [-_]at[-_] | at [\w-]++(?:\.\w| ?[\[({<*] ?(?:dot|\.)| [-_]?dot\b| \. )")
_BEFORE = re.compile(r"(?i)\b(?:(phone|tel|telephone|call|ring|mobile|cell|fax|whatsapp|sms|text|telefon|téléphone|teléfono|handy|portable|móvil)|(card|visa|mastercard|amex|credit|karte|carte|tarjeta)|(e-?mail|mail|contact|write|reach|correo|courriel|kontakt)|(ip|address|host|server|router|gateway|ping)|(order|invoice|ref|version|page|isbn|id|no|number|total|price|between|from|score|date|born|in|on|sku|case|ticket))\b")
_KNOWN_DOMAIN = re.compile(r"(?i)(?:\.|dot[\])}>* _-]*|\.[\])}>* ]*) ?(com|org|net|edu|gov|de|fr|es|it|nl|io|uk|eu|info|br|mx|ch|at|jp|in|ca|au)$")


def candidates(text: str) -> list[Span]:
    """Proposed spans beyond the base ones; they may overlap each other."""
    out: dict[Span, None] = {}
    has_at = "@" in text or "＠" in text or _AT_WORD.search(text.lower()) is not None
    has = {"at": has_at, ":": text.count(":") >= 7, "::": "::" in text, "(": "(" in text, "0": _DIGIT.search(text) is not None}
    for kind, pattern, needs in _GENERATORS:
        if has[needs]:
            out |= dict.fromkeys((kind, *m.span()) for m in pattern.finditer(text))
    return list(out)


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, a, b = span
    own, digits = text[a:b], _digits(text[a:b])
    groups = re.findall("[0-9]+", own)
    last = None
    for last in _BEFORE.finditer(text, max(0, a - 40), a):
        pass
    gap = a - last.end() if last else 99
    word = [float(bool(last and last.group(i)) and gap <= 16) for i in range(1, 6)]
    seps = set(re.sub("[0-9]", "", own))
    letters = re.sub(r"\W+|\d+", " ", own).split()
    return [
        float(KINDS.index(kind)), float(min(len(own), 1000)), float(min(len(digits), 1000)), float(min(len(groups), 1000)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(luhn(digits)) if digits else 0.0, float(own[0] == "("), float(own.startswith("0")),
        float(len(seps)), float("." in seps), float("/" in seps), float("-" in seps), float(" " in seps),
        float(bool(re.search(r"(?i)[\[({<*] ?(at|@)|@|＠|[-_]at[-_]", own))), float(bool(_KNOWN_DOMAIN.search(own))),
        float(len(letters[-1])) if letters else 0.0, float(max((int(g[-4:]) for g in groups), default=0) <= 255), float(":" in seps),
        *word,
    ]


N_FEATURES = 24


def training_sentences(n: int, seed: int) -> list[tuple[str, Span, bool]]:
    """Sentences from templates: the text, the span in it, and whether it is personal data.

    Forms and contexts of both classes overlap: a number without a telling word is a phone
    in some sentences and none in others, so scores between 0 and 1 arise and thresholds select.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = lambda text: rng.choice(text.split())
    fill = "please the report said we will when it was done after all items near this place with some more of them"
    name = lambda: pick("anna bo carla dev eli fatima gus hana ivo june kim lea mo nina omar pia quin rosa sam tess") + rng.choice(["", d(2), "." + pick("ray dole kerr lund moss"), "_" + pick("x ng li")])
    host = lambda: pick("acme globe north inbox mailer studio lab bank")
    tld = lambda: pick("com org net edu de fr es io uk eu it")
    word = lambda: pick(fill)
    at = lambda: rng.choice([" [at] ", "[at]", " (at) ", "(at)", " {at} ", " at ", " AT ", " <at> ", " @ ", " -at- ", "*at*"])
    dot = lambda: rng.choice([" [dot] ", "[dot]", " (dot) ", "(dot)", " dot ", " DOT ", " {dot} ", "[.]", " -dot- ", "*dot*"])

    def email() -> str:
        return rng.choice([f"{name()}{at()}{host()}{dot()}{tld()}", f"{name()}{at()}{host()}.{tld()}", f"{name()}@{host()}{dot()}{tld()}", f"{name()}{at()}{host()}{dot()}co{dot()}uk", f"josé{d(1)}@{host()}.{tld()}", f"{name()}＠{host()}.{tld()}"])

    def card(ok: bool) -> str:
        if rng.random() < 0.3:
            base, cuts = rng.choice(("34", "37")) + d(12), (4, 10)
        else:
            base, cuts = rng.choice("3456") + d(14), (4, 8, 12)
        own = base + next(x for x in "0123456789" if luhn(base + x) == ok)
        return rng.choice("./_\xa0–").join(own[i:j] for i, j in zip((0, *cuts), (*cuts, None)))

    def ip() -> str:
        group = lambda k: ":".join(f"{rng.randrange(65536):x}" for _ in range(k))
        short = rng.choice(("fe80", "2001:db8", "fd00", group(2))) + "::" + rng.choice((group(rng.randrange(1, 5)), d(1)))
        s = rng.choice(["[.]", " . ", " dot ", "(.)", " [dot] "])
        return rng.choice([short, group(8), s.join(str(rng.randrange(256)) for _ in range(4))])

    def phone() -> str:
        s = rng.choice([" ", "-", ".", "/", "\xa0", "–"])
        return rng.choice([f"({d(3)}){d(3)}-{d(4)}", f"1{s}{d(3)}{s}{d(3)}{s}{d(4)}", f"1 ({d(3)}) {d(3)}-{d(4)}", d(10), "1" + d(10), "0" + d(10), f"({d(3)}) {d(3)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(3)}{s}{d(3)}{s}{d(3)}", f"00{d(2)} {d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"])

    tell = "phone: |tel |tel.: |call |call me on |mobile |mobile: |fax |telefon |whatsapp |ring |text |cell: "
    none = "|the |we saw |"
    other = "order |order no |invoice |ref |ref: |version |page |ticket |sku |case "
    good = [
        (email, "write to |contact |e-mail: |mail |reach me at ||the |", "email"), (ip, "host |address |server |ping |from |the ||", "ip"),
        (lambda: card(True), "card |visa |credit card |amex |paid with ||", "card"), (phone, tell, "phone"), (phone, tell, "phone"), (phone, none, "phone"),
    ]
    bad = [
        (lambda: f"{word()}{rng.choice([' at ', ' at ', ' AT '])}{word()}{rng.choice([' dot ', ' . ', '.'])}{word()}", "|the |we |it |", "email"),
        (lambda: f"{word()} {rng.choice(['(at)', '@', '[at]'])} {word()}{rng.choice([' . ', '.', ' dot '])}{word()}", "|the |was |", "email"),
        (lambda: f"{pick('a de bad face add std ns')}::{pick('be cafe fee b map')}", "|the |in |ref ", "ip"),
        (lambda: rng.choice([" . ", " dot ", "[.]"]).join(d(3) for _ in range(4)), "version |ref |section |", "ip"),
        (lambda: card(False), "order |ref |number ||", "card"), (lambda: card(False), "card |ref ", "card"),
        (lambda: f"{rng.randrange(1900, 2030)}-{d(2)}-{d(2)}", "date |on |born ||", "phone"), (lambda: f"{d(2)}{rng.choice('./')}{d(2)}{rng.choice('./')}{rng.randrange(1900, 2030)}", "date |am |born ||", "phone"),
        (lambda: f"{d(3)} {d(3)}", "total |price ||between ", "phone"), (lambda: f"{d(3)}-{d(1)}{d(2)}-{d(5)}-{d(2)}", "isbn |ref |order ", "phone"),
        (phone, other, "phone"), (phone, other, "phone"), (phone, none, "phone"), (lambda: " ".join(d(2) for _ in range(rng.randrange(2, 6))), "score |total ||in |", "phone"),
    ]
    out = []
    for i in range(n):
        make, before, kind = rng.choice(good if i % 2 else bad)
        own, lead = make(), rng.choice(before.split("|"))
        left = "".join(word() + " " for _ in range(rng.randrange(0, 6)))
        text = left + lead + own + rng.choice([" ", ", ", ". ", "; "]) + " ".join(word() for _ in range(3))
        start = len(left) + len(lead)
        out.append((text, (kind, start, start + len(own)), bool(i % 2)))
    return out


@lru_cache(maxsize=1)
def scorer(seed: int = 5) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and each kind's threshold; trained in seconds, the same on every machine."""
    parts = [training_sentences(n, seed + i) for i, n in enumerate((6000, 4000, 6000))]
    x = [np.array([features(t, s) for t, s, _ in part]) for part in parts]
    y = [np.array([ok for _, _, ok in part]) for part in parts]
    trees = BoostedTrees().fit(x[0], y[0]).calibrate(x[1], y[1])
    p = trees.predict(x[2])
    kind = x[2][:, 0].astype(int)
    return trees, {k: max(0.5, lowest_threshold(p[kind == i], y[2][kind == i], PRECISION)) for i, k in enumerate(KINDS)}


def _free(taken: list[tuple[int, int]], a: int, b: int) -> int:
    """Where (a, b) goes among the disjoint intervals ``taken``; -1 if it overlaps one."""
    k = bisect.bisect_left(taken, (a, b))
    apart = (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0])
    return k if apart else -1


def _covered(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(texts: list[str], model: tuple[BoostedTrees, dict[str, float]]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each whole text; of overlapping candidates the best score wins, by binary search."""
    trees, threshold = model
    base = [base_spans(t) for t in texts]
    taken = [_covered(b) for b in base]
    rows = [(i, s) for i, t in enumerate(texts) if t for s in candidates(t) if _free(taken[i], *s[1:]) >= 0]
    p = trees.predict(np.array([features(texts[i], s) for i, s in rows]).reshape(-1, N_FEATURES))
    every = [list(b) for b in base]
    # of equal scores the longer span wins: a whole number, not its tail
    for k in sorted(range(len(rows)), key=lambda k: (-p[k], rows[k][0], rows[k][1][1] - rows[k][1][2], rows[k][1])):
        i, s = rows[k]
        if p[k] >= threshold[s[0]] and (at := _free(taken[i], *s[1:])) >= 0:
            taken[i].insert(at, s[1:])
            every[i].append(s)
    return [(b, in_order(e)) for b, e in zip(base, every, strict=True)]


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of ``documents``.

    Counts and base_sha256 are of the base spans; spans lists base and added ones as
    kind:start:end (code points, end exclusive).  A null text is empty: no spans.  Rows that
    repeat a doc_id are read each; an empty table gives an empty table; other columns are not
    read.  Work on a text is linear in its length, whatever runs of digits it holds.
    """
    model = scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans([t or "" for t in batch["text"].to_pylist()], model)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array(sha, pa.string()), pa.array([written(e) for _, e in found], pa.string()), pa.array([len(e) - len(b) for b, e in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are redacted as one, by the first one's kind."""
    cut = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    out, end = [], 0
    for a, b, k in sorted(cut):
        if a >= end:
            out += [text[end:a], f"[{k}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])
