"""Personal data by weak supervision.

Every text is searched for candidate spans. A candidate has a kind (email, ip, card, phone, secret) and a form: STRICT (a base pattern's match that holds),
FAILED (one that does not: a card number that fails its check, an address part above 255), LOOSE (national and bracketed writings of the four base kinds, version 6 addresses,
quoted values that are assigned to a name) or BARE (plain words that could spell an e-mail address, values without quotes). Candidates that overlap a base span are dropped before anything is counted.

Three labelers vote on each candidate, yes or no, or abstain:
* the pattern says yes to strict and no to failed ones, yes to keys of known make and quoted assignments, and abstains on all other loose forms;
* the gazetteer knows endings, calling codes, area codes, card issuers, reserved networks and the names under which secrets are kept;
* the context looks for cue words around the span, for signs that it is part of something longer, and whether a secret looks random.
The votes of all candidates of all documents are counted by kind, form, votes and shape, a table of bounded size. Expectation-maximisation over it estimates
each labeler's reliability (an abstention says nothing) and the probability of each pattern, with a prior for each kind and form; a logistic classifier of kind, form,
votes and shape is then trained on those probabilities and decides about the candidates. Base spans always stay; an added span overlaps neither them nor
another added one (the earliest and longest goes first).

Defined cases: a null or empty text has no spans; very long texts and runs are searched whole, in time proportional to their length; ties of candidates go to the earlier, then the
longer, then the kind listed first; repeated rows are searched each for itself; extra columns are ignored; an empty table gives an empty result, and no model is needed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.common import arrow_batches, materialize, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that the base patterns are of.
BASE_KINDS = 4
STRICT, FAILED, LOOSE, BARE = range(4)
THRESHOLD = 0.9
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failing start inside a run of digits fails as the run's start does, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Loose forms. Every repetition is bounded or possessive, so that a long run is passed once.
_LOOSE_PHONES = (
    re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    re.compile(r"(?<![0-9+.-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])"),
    re.compile(r"(?<![0-9+.-])00[1-9][0-9]{0,2}(?:[ /-][0-9]{2,8}){2,5}(?![0-9])"),
)
_LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[(\[{]at[)\]}]| at ) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[A-Za-z0-9-]{1,63}){1,8}", re.I
)
_LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:.])")
_LOOSE_CARD = re.compile(r"(?<![0-9.])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9])")
_ASSIGNED = re.compile(r"[:=] {0,2}([\"']?)([A-Za-z0-9][A-Za-z0-9_+/.-]{15,255}+={0,2})\1")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{0,40})[\"']? {0,2}$")
#: The beginnings and lengths of keys of known make.
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,64}|xox[abprs]-[A-Za-z0-9-]{10,64}|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])")
_BARE = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,128}+(?![A-Za-z0-9])")
#: Generic endings of domains; those of two letters are countries' and all count as known.
ENDINGS = frozenset("com org net edu gov int mil arpa aero app art asia biz blog cat cloud club coop dev email info jobs live mobi museum name news online page post pro shop site store tech tel travel wiki work world xyz".split())
#: Words that stand before "at" or "dot" in plain speech.
COMMON = frozenset("the a an my our your his her this that is are was were be been met look looked meet arrive arrived it we they you he she all here there and".split())
#: Calling codes of one and two digits, and the first two digits of those of three.
CALLING = ("1", "7"), tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()), tuple("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Card issuers by first digits and number of digits.
ISSUERS = (
    (re.compile(r"4"), (13, 16, 19)), (re.compile(r"5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720"), (16,)), (re.compile(r"3[47]"), (15,)),
    (re.compile(r"6011|64[4-9]|65"), (16, 19)), (re.compile(r"30[0-5]|3[689]"), (14, 16, 19)), (re.compile(r"35(?:2[89]|[3-8])"), (16, 17, 18, 19)), (re.compile(r"62"), (16, 17, 18, 19)), (re.compile(r"50|5[6-9]|6[0-9]"), (13, 14, 15, 16, 17, 18, 19)),
)
#: Parts of names under which secrets are kept.
SECRET_NAMES = re.compile(r"token|secret|passw|pwd|api_?-?key|access_?-?key|private_?-?key|auth|credential|bearer|client_?-?id|signature|session", re.I)
#: Cue words.
CUES = {
    "email": re.compile(r"mail|contact|write to|reach|correo|courriel|kontakt|contacto|\bescrib|\bécri|schreib", re.I),
    "ip": re.compile(r"\bip\b|ipv[46]|server|host|address|client|login|gateway|subnet|\bping\b|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay|\bcvv|expir", re.I),
    "phone": re.compile(r"phone|\btel|\bcall|mobile|\bcell|fax|telefon|\bappel|llam|rufnummer|anruf|portable|móvil|whatsapp", re.I),
    "secret": re.compile(r"token|secret|passw|\bkey\b|credential|bearer|auth|\bapi\b", re.I),
}
_VERSION = re.compile(r"(?:version|release|\bv)\.? ?$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern: from each @, back over the local part and on over the domain. In time proportional to the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in span.split("."))


def _base_matches(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(kind, start, end, form) of the base patterns' matches."""
    yield from ((0, a, b, STRICT) for a, b in emails(text))
    if not _DIGIT.search(text):
        return
    yield from ((1, *m.span(), STRICT if _octets(m.group()) else FAILED) for m in _IP.finditer(text))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            yield 2, *m.span(), STRICT if luhn(digits) else FAILED
    if "+" in text:
        yield from ((3, *m.span(), STRICT if 9 <= sum(c.isdigit() for c in m.group()) <= 15 else FAILED) for m in _PHONE.finditer(text))


def _loose(text: str) -> Iterator[tuple[int, int, int, int]]:
    lower = text.lower()
    if any(x in lower for x in ("(at)", "[at]", "{at}")) or (" at " in lower and " dot " in lower):
        yield from ((0, *m.span(), LOOSE if any(c in m.group() for c in "([{") else BARE) for m in _LOOSE_EMAIL.finditer(text))
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if _DIGIT.search(m.group(2)):
                yield 4, *m.span(2), LOOSE if m.group(1) else BARE
        yield from ((1, *m.span(), LOOSE) for m in _LOOSE_IP.finditer(text) if m.group().count(":") == 7 or "::" in m.group())
    if _DIGIT.search(text):
        for pattern in _LOOSE_PHONES:
            yield from ((3, *m.span(), LOOSE) for m in pattern.finditer(text))
        yield from ((2, *m.span(), LOOSE) for m in _LOOSE_CARD.finditer(text))
        yield from ((4, *m.span(), LOOSE) for m in _KEY.finditer(text))
        yield from ((4, *m.span(), BARE) for m in _BARE.finditer(text))


def _covered(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """What spans cover, as starts and ends of disjoint intervals."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free(covered: tuple[list[int], list[int]], start: int, end: int) -> bool:
    k = bisect_left(covered[0], end)
    return k == 0 or covered[1][k - 1] <= start


def search(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, form) of the base spans (STRICT) and of every candidate that overlaps none of them."""
    found = list(_base_matches(text))
    base = [x for x in found if x[3] == STRICT]
    covered = _covered([x[1:3] for x in base])
    rest: dict[tuple[int, int, int], int] = {}
    for k, a, b, form in [*_loose(text), *(x for x in found if x[3] != STRICT)]:
        if _free(covered, a, b):
            rest.setdefault((k, a, b), form)
    return base + [(*x, f) for x, f in rest.items()]


def _calling(digits: str) -> bool:
    return digits.startswith(CALLING[0]) or digits[:2] in CALLING[1] or digits[:2] in CALLING[2]


def _random(value: str) -> int:
    """Whether a value looks random: many different characters, letters and digits mixed."""
    n, digits = len(value), sum(c.isdigit() for c in value)
    shares = [value.count(c) / n for c in set(value)]
    entropy = -sum(x * math.log2(x) for x in shares)
    if sum(len(x) for x in re.split(r"[^A-Za-z0-9]+", value) if x.isalpha() and len(x) > 2 and x[1:].islower()) > n / 2:
        return 1  # words
    if entropy >= 3.0 and 0.1 <= digits / n <= 0.9 and not _DOMAIN.fullmatch(value):
        return 2
    return 1 if entropy < 2.5 or digits == 0 or _DOMAIN.fullmatch(value) else 0


def _gazetteer(text: str, kind: int, start: int, end: int) -> int:
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    if kind == 0:
        parts = re.split(r"[^a-z0-9-]+", span.rstrip(")]}").lower())
        last = parts[-1]
        if " at " in span.lower() and COMMON.intersection(parts[: parts.index("dot")] if "dot" in parts else parts):
            return 1
        return 2 if last in ENDINGS or (len(last) == 2 and last.isalpha()) else 1
    if kind == 1:
        if ":" in span:
            return 2 if span[0] in "2fF" else 0
        head = span.split(".")[0].lstrip("0")
        return 1 if not head or len(head) > 3 or int(head) > 223 else 2
    if kind == 2:
        return 2 if any(p.match(digits) and len(digits) in sizes for p, sizes in ISSUERS) else 1
    if kind == 3:
        if span.startswith(("+", "00")):
            return 2 if _calling(digits[2:] if span.startswith("00") else digits) else 1
        if len(digits) == 10 and span[0] != "0":  # area code and exchange begin with 2 to 9
            return 2 if digits[0] in "23456789" and digits[3] in "23456789" else 1
        return 2 if len(digits) == 10 and digits[1] != "8" else 0  # special rates have 08
    if _KEY.fullmatch(span):
        return 2
    name = _assigned_name(text, start)
    return 0 if name is None else 2 if SECRET_NAMES.search(name) else 1


def _assigned_name(text: str, start: int) -> str | None:
    """The name that the value at start is assigned to."""
    head = text[max(0, start - 50) : start].rstrip("\"'").rstrip(" ")
    if not head.endswith(("=", ":")):
        return None
    m = _NAME.search(head.rstrip("=:").rstrip(" "))
    return m.group(1) if m else ""


def votes(text: str, kind: int, start: int, end: int, form: int) -> tuple[int, int, int]:
    """Of pattern, gazetteer and context: 2 yes, 1 no, 0 abstains."""
    if kind == 4:
        quoted = text[max(0, start - 1) : start] in ("'", '"') and text[max(0, start - 1) : start] == text[end : end + 1]
        own = 2 if _KEY.fullmatch(text, start, end) or (form == LOOSE and quoted) else 0
    else:
        own = {STRICT: 2, FAILED: 1}.get(form, 0)
    known = _gazetteer(text, kind, start, end)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    cue = CUES[KINDS[kind]].search(before) or CUES[KINDS[kind]].search(text[end : end + CONTEXT // 2])
    if kind == 4:
        look = _random(text[start:end])
        return own, known, look if look != 0 or not cue else 2
    inside = before[-1:].isalnum() or after.isalnum() or (before[-1:] != "" and before[-1:] in "=_/") or (after != "" and after in "=_/")
    if inside or (kind == 1 and _VERSION.search(before)):
        return own, known, 1
    return own, known, 2 if cue else 0


def shape(text: str, kind: int, start: int, end: int) -> int:
    """A small number for what the span looks like: digits, spaces, hyphens."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    return 4 * min(3, digits // 5) + 2 * (" " in span) + ("-" in span)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            rows.append([{"kind": k, "start": a, "end": b, "strict": f == STRICT, "pattern": pattern_of(k, f, votes(text, k, a, b, f), shape(text, k, a, b))} for k, a, b, f in search(text)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPANS)], ["doc_id", "spans"])


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("pattern", pa.int32())]))
_SPANS_SQL = "array<struct<kind:int,start:bigint,end:bigint,strict:boolean,pattern:int>>"


def pattern_of(kind: int, form: int, vote: tuple[int, int, int], look: int) -> int:
    """All that the models see of a span, as one number below 5 * 4 * 27 * 16."""
    return (((kind * 4 + form) * 27) + vote[0] * 9 + vote[1] * 3 + vote[2]) * 16 + look


def _split(pattern: int) -> tuple[int, int, tuple[int, int, int], int]:
    rest, look = divmod(pattern, 16)
    group, v = divmod(rest, 27)
    return group // 4, group % 4, (v // 9, v // 3 % 3, v % 3), look


#: Votes that are taken as seen before any data: a labeler that votes is right four times in five.
_SEEN = np.array([[4.0, 1.0], [1.0, 4.0]])


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Expectation-maximisation: (prior of each kind and form, P(no or yes | class, voted) of each labeler and kind, P(personal | pattern))."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    parts = [_split(p) for p in patterns]
    kind, form = np.array([p[0] for p in parts], int), np.array([p[1] for p in parts], int)
    vote = np.array([p[2] for p in parts], int).reshape(-1, 3)
    # Start from the majority: yes counts 1, no counts -1; a tie says nothing.
    p = 1 / (1 + np.exp(-1.5 * ((vote == 2).sum(axis=1) - (vote == 1).sum(axis=1))))
    prior, given = np.full((len(KINDS), 4), 0.5), np.tile(_SEEN / 5, (3, len(KINDS), 1, 1))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            for f in range(4):
                mine = (kind == k) & (form == f)
                prior[k, f] = (1 + (n * p)[mine].sum()) / (2 + n[mine].sum())
            for j in range(3):
                for c, weight in ((0, n * (1 - p)), (1, n * p)):
                    seen = [_SEEN[c, v - 1] + weight[(kind == k) & (vote[:, j] == v)].sum() for v in (1, 2)]
                    given[j, k, c] = np.array(seen) / sum(seen)
        odds = np.log(prior[kind, form] / (1 - prior[kind, form]))
        for j in range(3):
            voted = vote[:, j] > 0
            at = (kind[voted], vote[voted, j] - 1)
            odds[voted] += np.log(given[j, at[0], 1, at[1]] / given[j, at[0], 0, at[1]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return prior, given, dict(zip(patterns, p.tolist(), strict=True))


def _row(pattern: int) -> np.ndarray:
    kind, form, vote, look = _split(pattern)
    x = np.zeros(1 + 5 + 4 + 9 + 16)
    x[0] = x[1 + kind] = x[6 + form] = x[19 + look] = 1
    for j, v in enumerate(vote):
        x[10 + 3 * j + v] = 1
    return x


def classifier(counts: dict[int, int], probable: dict[int, float], rounds: int = 40, ridge: float = 0.1) -> dict[int, float]:
    """A logistic model trained on the probabilities by Newton steps; its score of every pattern."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    x = np.stack([_row(p) for p in patterns])
    # A form that is found often must not drown the others: counts weigh by their square root.
    n, y = np.sqrt(np.array([counts[p] for p in patterns], float)), np.array([probable[p] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * s * (1 - s))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - s)) - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 4)
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def resolve(spans: list[dict], accepted: frozenset[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (kind, start, end), by kind, then start. Added ones don't overlap base spans or each other."""
    base = sorted((s["kind"], s["start"], s["end"]) for s in spans if s["strict"])
    covered = _covered([(a, b) for _, a, b in base])
    added, reach = [], 0  # candidates come by start, so of the added ones only the furthest end matters
    for s in sorted((s for s in spans if not s["strict"] and s["pattern"] in accepted), key=lambda s: (s["start"], -s["end"], s["kind"])):
        if s["start"] >= reach and _free(covered, s["start"], s["end"]):
            added.append((s["kind"], s["start"], s["end"]))
            reach = s["end"]
    return base, sorted(base + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _decide(accepted: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [resolve(spans, accepted) for spans in batch.column("spans").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(BASE_KINDS)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, digests, pa.array([written(s) for _, s in found], pa.string()), added], ["doc_id", *[f"n_{k}" for k in KINDS[:BASE_KINDS]], "base_sha256", "spans", "n_added"]
            )

    return run


def accepted_patterns(counts: dict[int, int], threshold: float = THRESHOLD) -> frozenset[int]:
    """The patterns whose spans the trained classifier takes."""
    _, _, probable = reliabilities(counts)
    return frozenset(p for p, s in classifier(counts, probable).items() if s >= threshold)


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans and n_added of every row."""
    arrow_batches(docs.sparkSession, megabytes=8)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_candidates, f"doc_id long, spans {_SPANS_SQL}")
    slim = materialize(rows, "pii-candidates")
    counted = slim.select(F.explode("spans").alias("s")).groupBy("s.pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8640 patterns
    accepted = accepted_patterns({r["pattern"]: r["n"] for r in counted}, threshold)
    return slim.mapInArrow(_decide(accepted), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """text with every span (as in find()) replaced by its kind in brackets."""
    for kind, a, b in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: -int(s[1])):
        text = f"{text[: int(a)]}[{kind}]{text[int(b) :]}"
    return text


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
