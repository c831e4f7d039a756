"""Secret scan: three fixed patterns, and a linear-chain conditional random field that adds what they don't catch.

The field tags tokens as outside (O), begin (B) or inside (I) a secret. Its features are the token's shape (characters
used, length, changes between letters and digits), the neighbouring words, and facts about the whole text; Viterbi
decoding gives the best tags. A token can only be B or I if it is strong (8 or more ASCII characters with a digit, or 20
or more) or stands close behind a key word, which may be a part of a name (DB_PASSWORD, clientSecret); elsewhere O is certain, so only the stretches around such tokens need
potentials, and the result is that of decoding the whole text. Texts without any are told apart by array operations.

The weights are learned from generated lines (TRAINING_LINES of them, seeded), so the model doesn't depend on the corpus.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from driftwood.llm import shared

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
TRAINING_LINES = 1200

_TOKEN = re.compile(r"\w(?:[\w+/.\-]*\w)?|\S")
_KEYS = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|key|bearer|basic|auth(?:orization)?|credentials?|private|access_key|signature)"
_KEYWORD = re.compile(_KEYS, re.IGNORECASE | re.ASCII)
#: A key word as a part of a name: bounded by anything but letters, or by a change of case.
_PART = re.compile(rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:{_KEYS})(?:(?![A-Za-z])|(?=[A-Z]))", re.ASCII)
#: Texts that may hold a base match or a key word, for the array search over whole slices.
_MAY = r"(?i:pass|pwd|secret|token|key|bearer|basic|auth|credential|private|signature)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
#: Tokens behind a key word that may be secret whatever their shape.
REACH = 4
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    value: int  # where the secret itself starts


def base_spans(text: str) -> list[Span]:
    """Of the fixed patterns; offsets in code points, end exclusive."""
    found = [Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [Span(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(found)


def strong(token: str) -> bool:
    return token.isascii() and (len(token) >= 20 or len(token) >= 8 and any(map(str.isdigit, token)))


def _shape(token: str) -> list[str]:
    if len(token) == 1 and not token.isalnum():
        return [f"c={token}" if token.isascii() else "c=other"]
    lower, upper, digit = (any(map(f, token)) for f in (str.islower, str.isupper, str.isdigit))
    symbol = not token.isalnum()
    kind = "".join(c for c, on in zip("aA0-", (lower, upper, digit, symbol), strict=True) if on)
    size = next(k for k, n in enumerate((4, 8, 12, 16, 20, 32, 10**9)) if len(token) < n)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    hexa = digit and all(c in "0123456789abcdefABCDEF" for c in token)
    cap = lower and upper and not digit and token[1:].islower()
    return [f"s={kind}", f"n={size}", f"s={kind}{size}", f"t={min(changes, 6) // 2}", f"t={kind}{min(changes, 6) // 2}", f"h={hexa}{size}", f"cap={cap}"]


def _word(token: str | None) -> str:
    if token is None:
        return "edge"
    if _KEYWORD.fullmatch(token):
        return "k:" + token.lower()
    if _PART.search(token):
        return "k:part"
    if len(token) == 1 and not token.isalnum():
        return token if token.isascii() else "other"
    return "number" if token.isdigit() else "strong" if strong(token) else "word"


def _facts(text: str) -> list[str]:
    n = len(text) + 1
    marks = sum(map(text.count, "=:{};\"'"))
    return [f"f={min(3, 40 * marks // n)}", f"fn={min(3, n.bit_length() // 4)}", "f"]


class Sequence(NamedTuple):
    spans: list[tuple[int, int]]  # of the tokens
    free: list[int]  # those that can be B or I
    features: list[list[str]]  # of those


def sequence(text: str) -> Sequence:
    matches = list(_TOKEN.finditer(text))
    spans = [m.span() for m in matches]
    tokens = [m[0] for m in matches]
    near, free = -1, []
    for i, t in enumerate(tokens):
        if strong(t) or i <= near and (len(t) > 1 or t == "="):
            free.append(i)
        if _PART.search(t):
            near = i + REACH
    facts = _facts(text) if free else []
    at = lambda i: _word(tokens[i] if 0 <= i < len(tokens) else None)
    features = [[*_shape(tokens[i]), f"-1{at(i - 1)}", f"-2{at(i - 2)}", f"-3{at(i - 3)}", f"+1{at(i + 1)}", f"-12{at(i - 1)}{at(i - 2)}", *facts] for i in free]
    return Sequence(spans, free, features)


# --- learning -------------------------------------------------------------------------------------------------------


def training_lines(n: int = TRAINING_LINES, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated texts with the places of their secrets."""
    rnd = random.Random(seed)
    some = lambda alphabet, low, high: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(low, high)))
    words = lambda k: " ".join(some(string.ascii_lowercase, 2, 9) for _ in range(k))
    alnum, b64, hexa, digits = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.digits
    mixed = lambda low, high: rnd.choice("abcdefgh") + some(alnum, low, high) + rnd.choice(digits) + rnd.choice("XYZQ")
    values = [lambda: some(hexa, 32, 40), lambda: mixed(16, 40), lambda: "ghp_" + mixed(30, 36), lambda: "sk-" + mixed(24, 48), lambda: "AKIA" + some(string.ascii_uppercase + digits, 16, 16), lambda: "eyJ" + some(b64, 20, 40) + "." + some(b64, 20, 60) + "9", lambda: "xoxb-" + some(digits, 10, 12) + "-" + mixed(20, 24)]
    short = [lambda: mixed(6, 10), lambda: some(string.ascii_lowercase, 5, 8) + some(digits, 2, 4), lambda: some(alnum, 9, 14) + "7"]
    keys = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "credential", "Password", "SECRET", "passphrase", "DB_PASSWORD", "client_secret", "aws_secret_access_key", "auth_token", "API-KEY", "clientSecret", "userPassword", "smtp.password", "GITHUB_TOKEN"]
    number = lambda low, high: str(rnd.randint(low, high))
    plain = [lambda: some(digits, 8, 16), lambda: f"+{rnd.randint(1, 99)} ({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}", lambda: f"({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}", lambda: " ".join(some(digits, 4, 4) for _ in range(4)), lambda: f"{some(digits, 3, 3)}-{some(digits, 2, 2)}-{some(digits, 4, 4)}", lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", lambda: some(string.ascii_lowercase, 3, 8) + "." + some(digits, 2, 2), lambda: f"version-{rnd.randint(1, 9)}.{rnd.randint(10, 99)}.{rnd.randint(1, 9)}", lambda: "https://" + some(string.ascii_lowercase, 5, 9) + ".com/" + some(string.ascii_lowercase, 4, 9) + str(rnd.randint(1, 99)), lambda: some(string.ascii_lowercase, 3, 8) + str(rnd.randint(1, 99)) + "@mail" + str(rnd.randint(1, 9)) + ".example.com", lambda: some(string.ascii_lowercase, 20, 28), lambda: "chapter" + some(digits, 1, 3), lambda: f"192.168.{rnd.randint(100, 255)}.{rnd.randint(100, 255)}", lambda: f"555-{some(digits, 3, 3)}-{some(digits, 4, 4)}", lambda: some(string.ascii_lowercase, 4, 7) + "_" + some(string.ascii_lowercase, 4, 7) + str(rnd.randint(1, 9))]
    plain += [
        lambda: ".".join(number(0, 255) for _ in range(4)),  # addresses, also with a port
        lambda: ".".join(number(1, 255) for _ in range(4)) + ":" + number(80, 9999),
        lambda: ".".join(number(100, 255) for _ in range(4)),
        lambda: ":".join(some(hexa, 2, 2) for _ in range(6)),
        lambda: ":".join(some(hexa, 4, 4) for _ in range(8)),
        lambda: f"{number(1, 20)}.{number(0, 30)}.{number(100, 30000)}.{number(0, 9)}",  # versions
        lambda: f"v{number(1, 20)}.{number(0, 30)}.{number(0, 99)}-rc{number(1, 9)}",
        lambda: f"{number(1990, 2030)}-{number(10, 12)}-{number(10, 28)}T{number(10, 23)}:{number(10, 59)}:{number(10, 59)}",  # times
        lambda: f"{number(1990, 2030)}{number(10, 12)}{number(10, 28)}T{number(100000, 235959)}",
        lambda: f"{number(10, 28)}/{number(10, 12)}/{number(1990, 2030)}",
        lambda: f"{rnd.choice(['ORD', 'INV', 'order', 'ticket', 'PO', 'RFC'])}-{number(1990, 2030)}-{some(digits, 4, 7)}",  # numbers of things
        lambda: f"{rnd.choice(['IMG', 'DSC', 'scan', 'report'])}_{some(digits, 4, 8)}.{rnd.choice(['jpg', 'pdf', 'txt'])}",
        lambda: f"{number(10, 60)}.{some(digits, 5, 7)}",
        lambda: f"978-{number(0, 9)}-{some(digits, 4, 4)}-{some(digits, 4, 4)}-{number(0, 9)}",
        lambda: some(string.ascii_lowercase, 4, 9) + "-" + some(string.ascii_lowercase, 4, 9) + "-" + some(string.ascii_lowercase, 4, 9),
    ]
    out = []
    for _ in range(n):
        text, spans = words(rnd.randint(1, 8)) + rnd.choice([" ", ". ", "\n"]), []
        for _ in range(rnd.randint(1, 3)):
            kind = rnd.random()
            if kind < 0.45:
                link = rnd.choice([" = ", "=", ": ", ":", ' = "', " is ", " ", ' => "', "='", ' : "'])
                lead, value = rnd.choice(keys) + link, rnd.choice(values if rnd.random() < 0.7 else short)()
            elif kind < 0.6:
                lead, value = rnd.choice(["Authorization: Bearer ", "bearer ", "Authorization: Basic ", "auth ", "private key "]), rnd.choice(values)()
            elif kind < 0.7:
                lead, value = rnd.choice(["", "use ", "(", '"']), rnd.choice(values)()
            elif kind < 0.8:
                lead, value = rnd.choice(keys) + rnd.choice([" ", " of ", ": "]), None
            else:
                lead, value = rnd.choice(["", "see ", "call ", "id ", "= ", ": ", "number "]), None
                text, lead = text + lead + rnd.choice(plain)(), " "
            text += lead
            if value:
                spans.append((len(text), len(text) + len(value)))
                text += value
                if lead[-1:] and lead[-1:] in "\"'":
                    text += lead[-1]
                if rnd.random() < 0.15:  # one secret over several tokens
                    more = " ".join(rnd.choice(values[:2])() for _ in range(rnd.randint(1, 2)))
                    text += " " + more
                    spans[-1] = (spans[-1][0], len(text))
            text += rnd.choice([" ", ", ", ". ", "\n"]) + words(rnd.randint(1, 6)) + " "
        out.append((text, spans))
    return out


class Model(NamedTuple):
    index: dict[str, int]
    emit: np.ndarray  # of each feature and of O, B, I
    move: np.ndarray  # from state to state


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


#: O cannot be followed by I.
_FORBID = np.array([[0.0, 0.0, -1e4], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def fit(lines: list[tuple[str, list[tuple[int, int]]]], steps: int = 90, rate: float = 0.15, decay: float = 2e-3) -> Model:
    """Maximum likelihood with L2 decay by Adam; all stretches of free tokens at once, forward-backward in log space."""
    index: dict[str, int] = {}
    stretches: list[tuple[list[list[int]], list[int]]] = []
    for text, secrets in lines:
        seq = sequence(text)
        tags = {}
        for a, b in secrets:
            inside = [i for i, (x, y) in enumerate(seq.spans) if x < b and y > a]
            tags |= {i: 1 if k == 0 else 2 for k, i in enumerate(inside)}
        last = None
        for i, names in zip(seq.free, seq.features, strict=True):
            if last is None or i != last + 1:
                stretches.append(([], []))
            stretches[-1][0].append([index.setdefault(x, len(index)) for x in names])
            stretches[-1][1].append(tags.get(i, 0))
            last = i
    n, t, m = len(stretches), max(len(y) for _, y in stretches), max(len(f) for fs, _ in stretches for f in fs)
    feats, gold, mask = np.full((n, t, m), len(index)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for k, (fs, y) in enumerate(stretches):
        for j, f in enumerate(fs):
            feats[k, j, : len(f)] = f
        gold[k, : len(y)], mask[k, : len(y)] = y, True
    gold[(gold == 2) & (np.pad(gold, ((0, 0), (1, 0)))[:, :-1] == 0)] = 1  # nothing starts with I
    emit, move = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    observed, moves = np.zeros_like(emit), np.zeros_like(move)
    np.add.at(observed, (feats[mask], gold[mask][:, None]), 1)
    before = np.pad(gold, ((0, 0), (1, 0)))[:, :-1]
    np.add.at(moves, (before[mask], gold[mask]), 1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, move)]
    for step in range(1, steps + 1):
        score = emit[feats].sum(axis=2)
        score[~mask] = [0.0, -1e4, -1e4]
        hop = move + _FORBID
        alpha = np.empty((n, t, 3))
        prior = np.broadcast_to(np.array([0.0, -1e4, -1e4]), (n, 3))  # O stands before a stretch
        for j in range(t):
            prior = alpha[:, j] = _log_sum(prior[:, :, None] + hop, 1) + score[:, j]
        beta = np.zeros((n, t, 3))
        for j in range(t - 2, -1, -1):
            beta[:, j] = _log_sum(hop[None] + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
        total = _log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - total[:, None, None])
        left = np.concatenate([np.broadcast_to(np.array([0.0, -1e4, -1e4]), (n, 1, 3)), alpha[:, :-1]], axis=1)
        pair = np.exp(left[:, :, :, None] + hop + (score + beta)[:, :, None, :] - total[:, None, None, None])
        expected, expected_moves = np.zeros_like(emit), pair[mask].sum(axis=0)
        np.add.at(expected, feats[mask], node[mask][:, None, :])
        for k, (x, grad) in enumerate(((emit, (observed - expected) / n - decay * emit), (move, (moves - expected_moves) / n - decay * move))):
            a, b = state[k]
            a += 0.1 * (grad - a)
            b += 0.02 * (grad * grad - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-8)
        emit[-1] = 0
    return Model(index, emit[:-1], move)


@functools.cache
def model() -> Model:
    return fit(training_lines())


# --- decoding -------------------------------------------------------------------------------------------------------


def viterbi(seq: Sequence, m: Model) -> list[int]:
    """The best tag of each free token; between stretches of them all is O."""
    hop = (m.move + _FORBID).tolist()
    tags: list[int] = []
    k = 0
    while k < len(seq.free):
        end = k + 1
        while end < len(seq.free) and seq.free[end] == seq.free[end - 1] + 1:
            end += 1
        best, back = [0.0, -1e9, -1e9], []
        for j in range(k, end):
            known = [m.index[x] for x in seq.features[j] if x in m.index]
            e = m.emit[known].sum(axis=0).tolist()
            came = [max(range(3), key=lambda s, to=to: best[s] + hop[s][to]) for to in range(3)]
            best = [best[came[to]] + hop[came[to]][to] + e[to] for to in range(3)]
            back.append(came)
        tag = max(range(3), key=lambda s: best[s] + (hop[s][0] if seq.free[end - 1] + 1 < len(seq.spans) else 0.0))
        mine = []
        for came in reversed(back):
            mine.append(tag)
            tag = came[tag]
        tags += mine[::-1]
        k = end
    return tags


def field_spans(text: str, m: Model) -> list[Span]:
    seq = sequence(text)
    found: list[list[int]] = []
    for i, tag in zip(seq.free, viterbi(seq, m), strict=True):
        a, b = seq.spans[i]
        if tag == 1:
            found.append([a, b])
        elif tag == 2:
            found[-1][1] = b
    return [Span(a, 3, b, a) for a, b in found]


def all_spans(text: str, m: Model) -> list[Span]:
    """The base spans, and those of the field that don't lie inside them; the field's may overlap base spans."""
    base = base_spans(text)
    starts, ends = [], []  # what the base spans cover, joined
    for x in base:
        if ends and x.start <= ends[-1]:
            ends[-1] = max(ends[-1], x.end)
        else:
            starts.append(x.start)
            ends.append(x.end)

    def covered(x: Span) -> bool:
        k = bisect.bisect_right(starts, x.start) - 1
        return k >= 0 and x.end <= ends[k]

    return sorted(base + [x for x in field_spans(text, m) if not covered(x)])


def suspects(texts: pa.Array) -> np.ndarray:
    """Which texts may hold any span; the others surely hold none."""
    may = pc.fill_null(pc.match_substring_regex(texts, _MAY), False).to_numpy(zero_copy_only=False).astype(bool)
    raw, offsets = shared.buffers(texts)
    if len(raw):
        inside = _RUN[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw], dtype=np.int64)])
        size = ends - starts
        hit = (size >= 20) | (size >= 8) & (digits[ends] > digits[starts])
        # a run may go on over the next text's start; then both count
        may[np.unique(np.searchsorted(offsets, starts[hit], side="right") - 1)] = True
        may[np.unique(np.searchsorted(offsets, ends[hit] - 1, side="right") - 1)] = True
        for k in np.flatnonzero(hit & (np.searchsorted(offsets, ends - 1, side="right") - np.searchsorted(offsets, starts, side="right") > 1)):
            may[np.searchsorted(offsets, starts[k], side="right") - 1 : np.searchsorted(offsets, ends[k] - 1, side="right")] = True
    return may


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long"


def scan(docs: DataFrame) -> DataFrame:
    """Per document the counts and places of its secrets.

    A null text counts as empty; it and texts without secrets give zeros and the empty list. Null ids and repeated rows
    stay rows of their own. An empty table gives no rows. Further columns are not read.
    """
    m = model()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            n = part.num_rows
            found: list[list[Span]] = [[]] * n
            texts = part.column("text")
            for k in np.flatnonzero(suspects(texts)).tolist():
                found[k] = all_spans(texts[k].as_py() or "", m)
            counts = [pa.array([sum(s.kind == kind for s in x) for x in found], pa.int64()) for kind in range(4)]
            digests = [hashlib.sha256(_said([s for s in x if s.kind < 3]).encode()).hexdigest() for x in found]
            yield pa.record_batch([part.column("doc_id"), *counts[:3], pa.array(digests, pa.string()), pa.array(list(map(_said, found)), pa.string()), counts[3]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCHEMA)


def redact_text(text: str, m: Model, mark: str = "[SECRET]") -> str:
    """The text with the mark for each secret; an assignment keeps its key."""
    out, at = [], 0
    for s in sorted((s.value, s.end) for s in all_spans(text, m)):
        if s[0] >= at:
            out += [text[at : s[0]], mark]
        at = max(at, s[1])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret in their texts replaced by the mark; all columns and rows stay."""
    m = model()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            texts = part.column("text")
            hits = np.flatnonzero(suspects(texts)).tolist()
            if hits:
                new = texts.to_pylist()
                for k in hits:
                    new[k] = None if new[k] is None else redact_text(new[k], m, mark)
                part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(new, texts.type))
            yield part

    return docs.mapInArrow(task, docs.schema)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))
