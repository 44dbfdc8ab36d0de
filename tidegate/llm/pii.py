"""Personal data by weak supervision.

Candidate spans come from strict patterns and from looser ones: written-out addresses, numbers without a
country code, other notations, and matches that fail the strict checks (sums, lengths, octets). Labelling functions -
pattern, check, gazetteer, context, shape and placeholder - vote on every candidate. Expectation-maximisation over the counts of all vote patterns in the corpus estimates
each labeller's reliability. Its posteriors are the soft labels of a logistic span classifier, which sees the
span itself and the words around it, never the votes, and decides on the loose candidates. Strict spans always
stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
LABELLERS = ("pattern", "check", "gazetteer", "context", "shape", "placeholder")
#: Hashed features of a span, and candidates that the span classifier is fitted on at most.
FEATURE_BUCKETS, SAMPLE_SPANS = 1024, 20_000

# strict patterns, written so that long runs cost no backtracking
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# looser notations
_SIGN = r"[\[({] ?at ?[\])}]"
_AT_SIGN = re.compile(_SIGN, re.I)
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?" + _SIGN + r" ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]++)++", re.I)
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9.])")

# gazetteers
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es it uk us eu ch at nl be pt pl ca mx br ar au jp cn in ru example".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421".split())
CUES = {
    "email": frozenset("mail email e-mail contact write address courriel correo schreiben".split()),
    "ip": frozenset("ip server host address addr adresse client dirección".split()),
    "card": frozenset("card visa mastercard credit debit payment carte karte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell contact téléphone telefon teléfono anruf".split()),
}

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, low = text.find("@"), 0
    while at >= 0:
        start = at - len(run) + len(run.rstrip(_LOCAL)) if (run := text[low:at]) else at
        low = at + 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            low = found.end()
        at = text.find("@", low)


def strict_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check; a failing match is dropped whole."""
    spans = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        spans += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def failed_spans(text: str) -> list[Span]:
    """Matches of the strict patterns that fail their check and are near enough to what passes to be a slip or a look-alike."""
    spans = [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p) <= 3 for p in m[0].split(".")) and any(int(p) > 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) in (13, 20) or 14 <= len(digits) <= 19 and not luhn(digits):
            spans.append((*m.span(), "card"))
    return spans + [(*m.span(), "phone") for m in _PHONE.finditer(text) if len(_DIGIT.findall(m[0])) in (7, 8, 9, 16, 17)]


def passes(value: str, kind: str, digits: str) -> str:
    """The vote of what a value of its kind must satisfy, whatever its notation; 0 where that says nothing."""
    if kind == "card":
        return "+" if 14 <= len(digits) <= 19 and luhn(digits) else "-"
    if kind == "ip":
        return "+" if ":" in value or all(int(p.lstrip("0")[:4] or 0) <= 255 for p in value.split(".")) else "-"
    return "0" if kind == "email" else "+" if 10 <= len(digits) <= 15 else "-"


def loose_spans(text: str, strict: list[Span]) -> list[Span]:
    """Candidates in other notations and failed matches, left to right, that touch neither strict spans nor each other."""
    found: list[Span] = []
    if _AT_SIGN.search(text):
        found += [(*m.span(), "email") for m in _AT.finditer(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), "phone") for m in _NATIONAL.finditer(text)]
        found += [(*m.span(), "card") for m in _DOTTED_CARD.finditer(text)]
        if text.count(":") >= 7:
            found += [(*m.span(), "ip") for m in _IP6.finditer(text)]
        found += failed_spans(text)
    taken, out = sorted((s, e) for s, e, _ in strict), []
    for s, e, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))):
        if all(e <= a or s >= b for a, b in taken):
            out.append((s, e, kind))
            taken.append((s, e))
    return out


def votes(text: str, span: Span, is_strict: bool) -> str:
    """The kind and each labeller's vote (+, - or 0 for none)."""
    start, end, kind = span
    value = text[start:end]
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        known = re.split(r"[.\])} ]+", value.lower().rstrip("])} "))[-1] in TOP_DOMAINS
    elif kind == "ip":
        known = ":" in value or 1 <= int(value.split(".")[0].lstrip("0")[:4] or 0) <= 223
    elif kind == "card":
        known = digits[0] in "3456"
    else:
        known = any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) if value[0] == "+" else digits[0] > "1" and digits[3] > "1"
    before = re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())
    near = any(w in CUES[kind] for w in before[-4:])
    whole = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    dull = len(set(digits)) == 1 and len(digits) > 3 or digits in ("1234567890", "0123456789") or "noreply" in value.lower()
    signs = ("+" if is_strict else "-", passes(value, kind, digits), "+" if known else "-", "+" if near else "0", "+" if whole else "-", "-" if dull else "0")
    return f"{kind}:" + "".join(signs)


_WORD = re.compile(r"[^\W\d_]+")
#: What the shape of a span writes for each sign: digits, letters, white space; others stay.
_SHAPE = str.maketrans({**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "a"), "\t": " ", "\n": " "})


def span_features(text: str, span: Span) -> list[int]:
    """Buckets, sorted and distinct, of what a span and its surroundings look like.

    Its kind with: runs of its shape, number of digits and of distinct digits, length, its first and last words,
    the signs beside it, and the words before and after it.
    """
    start, end, kind = span
    value = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", value.translate(_SHAPE))
    digits = [c for c in value if c.isdigit()]
    names = [f"shape {shape[k : k + 3]}" for k in range(max(1, len(shape) - 2))]
    names += [f"digits {len(digits)}", f"distinct {len(set(digits))}", f"length {min(len(value) // 4, 12)}", f"first digits {''.join(digits[:2])}"]
    inside = _WORD.findall(value.lower())
    names += [f"first {inside[0]}", f"last {inside[-1]}"] if inside else ["no letters"]
    names += [f"left {text[max(0, start - 1) : start]}", f"right {text[end : end + 1]}"]
    names += [f"before {w}" for w in _WORD.findall(text[max(0, start - 40) : start].lower())[-4:]]
    names += [f"after {w}" for w in _WORD.findall(text[end : end + 30].lower())[:2]]
    return sorted({xxhash.xxh3_64_intdigest(f"{kind} {n}".encode("utf-8", "surrogatepass")) % FEATURE_BUCKETS for n in [*names, ""]})


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, strict, loose): spans of every whole text with vote patterns and features, a null text being empty."""
    spans = "array<struct<start:int,end:int,kind:string,votes:string,features:array<int>>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list] = ([], [])
            for text in batch.column(1):
                text = text.as_py() or ""
                strict = strict_spans(text)
                for out, spans, sure in ((rows[0], strict, True), (rows[1], loose_spans(text, strict), False)):
                    out.append([{"start": s, "end": e, "kind": k, "votes": votes(text, (s, e, k), sure), "features": span_features(text, (s, e, k))} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x in rows)], ["doc_id", "strict", "loose"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, f"doc_id long, strict {spans}, loose {spans}")


def vote_counts(found: DataFrame) -> dict[str, int]:
    """How often each vote pattern occurs in the corpus: at most 4 * 3 ** 6 rows."""
    rows = found.select(F.explode(F.concat("strict", "loose")).alias("s")).groupBy("s.votes").count().collect()
    return {r[0]: r[1] for r in rows}


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray, dict[str, float]]:
    """Expectation-maximisation over vote patterns.

    Returns the prior of each kind, each labeller's probabilities of votes (-, 0, +) given truth, smoothed, and
    the posterior of each pattern.
    """
    names = sorted(counts)
    n = np.array([counts[p] for p in names], float)
    kinds = np.array([KINDS.index(p.split(":")[0]) for p in names], int)
    vote = np.array([["-0+".index(c) for c in p.split(":")[1]] for p in names], int).reshape(-1, len(LABELLERS))
    table = np.tile(np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]), (len(LABELLERS), 1, 1))  # [labeller, truth, vote]
    prior, post = np.full(len(KINDS), 0.5), np.full(len(names), 0.5)
    for _ in range(rounds):
        log = np.stack([np.log(np.clip(1 - prior[kinds], 1e-9, 1)), np.log(np.clip(prior[kinds], 1e-9, 1))], 1)
        for j in range(len(LABELLERS)):
            log += np.log(table[j][:, vote[:, j]]).T
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        for k in range(len(KINDS)):
            of = kinds == k
            prior[k] = (1 + (n * post)[of].sum()) / (2 + n[of].sum())
        for j in range(len(LABELLERS)):
            for truth, weight in ((0, n * (1 - post)), (1, n * post)):
                # prior counts keep a labeller better than chance where a truth is hardly seen
                seen = np.bincount(vote[:, j], weight, 3) + 20 * np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]])[truth]
                table[j, truth] = seen / seen.sum()
    return dict(zip(KINDS, prior.tolist(), strict=True)), table, dict(zip(names, post.tolist(), strict=True))


def fit_spans(features: list[list[int]], soft: np.ndarray, rounds: int = 300, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic classifier of spans by their buckets, by Adam on soft labels; both sides weigh alike."""
    w = np.zeros(FEATURE_BUCKETS)
    if not len(soft):
        return w
    at, of = np.concatenate([np.asarray(f, np.int64) for f in features]), np.repeat(np.arange(len(soft)), [len(f) for f in features])
    share = np.clip(soft.mean(), 1e-3, 1 - 1e-3)
    weight = (soft * 0.5 / share + (1 - soft) * 0.5 / (1 - share)) / len(soft)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for n in range(1, rounds + 1):
        wrong = weight * (1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(soft)), -30, 30))) - soft)
        slope = np.bincount(at, wrong[of], FEATURE_BUCKETS) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        w -= rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.999**n)) + 1e-9)
    return w


def train_spans(found: DataFrame, sample_spans: int = SAMPLE_SPANS) -> np.ndarray:
    """The span classifier of a table of `candidates`.

    Reliabilities come from the votes on every candidate. The classifier is fitted on at most `sample_spans`
    candidates of their posteriors: half of them loose ones at most, those of smallest hash, so that reruns agree.
    """
    counts = vote_counts(found)
    if not counts:
        return np.zeros(FEATURE_BUCKETS)
    post = reliabilities(counts)[2]
    rows: list = []
    for side in ("strict", "loose"):
        spans = found.select("doc_id", F.explode(side).alias("s")).select(F.xxhash64("doc_id", "s.start", "s.features").alias("at"), "s.votes", "s.features")
        rows += spans.orderBy("at", "votes").limit(sample_spans // 2).collect()
    return fit_spans([r["features"] for r in rows], np.array([post[r["votes"]] for r in rows]))


def accepts(weights: np.ndarray, features: list[int]) -> bool:
    return float(weights[np.asarray(features, np.int64)].sum()) > 0


def _joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def _ordered(strict: list[dict], loose: list[dict], weights: np.ndarray) -> list[dict]:
    kept = strict + [s for s in loose if accepts(weights, s["features"])]
    return sorted(kept, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def detect(docs: DataFrame) -> DataFrame:
    """Every row's spans: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the strict ones, spans of all, n_added.

    The text is read once; candidates stay in a narrow table while the classifier is trained. A text that is
    null, empty or without candidates has no spans; one of any length is searched whole; candidates that start
    together stand in the order of KINDS; repeated rows each get a row, an empty table none; columns beside doc_id
    and text are ignored.
    """
    found = stored(candidates(docs), "pii-candidates")
    weights = train_spans(found)
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, strict, loose in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = _ordered(strict, loose, weights)
                counts = [sum(s["kind"] == k for s in strict) for k in KINDS]
                rows.append((doc_id, *counts, sha256(_joined(strict).encode()).hexdigest(), _joined(spans), len(spans) - len(strict)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in brackets; a null text stays null.

    Of overlapping spans the union is replaced, under the kind of the first. The classifier is trained on all
    rows first; the texts are searched again rather than shuffled.
    """
    found = candidates(docs).where((F.size("strict") > 0) | (F.size("loose") > 0))
    weights = train_spans(stored(found, "pii-candidates"))
    names = docs.columns
    at = names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else mask_text(t, weights) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(apply, docs.schema)


def mask_text(text: str, weights: np.ndarray) -> str:
    strict = strict_spans(text)
    spans = strict + [s for s in loose_spans(text, strict) if accepts(weights, span_features(text, s))]
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text
