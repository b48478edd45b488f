"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as secret begin, inside or outside. Its features are the token's
shape (length, alphabet, changes between letters and digits, variety of characters),
the word before and after, the mark before, and two features of the whole file. It is
trained by maximum likelihood on a bounded sample of texts. Into any of them secrets of many shapes are
planted, with and without a word or mark before them, beside harmless tokens that look alike: identifiers, links,
image data, file names, version numbers, long words. Matches of the patterns are examples too; in a third of
them the pattern's keyword is hidden, in another third the secret is replaced by a random
one of another alphabet. So the field learns secrets that no pattern finds. Decoding is exact Viterbi over whole texts: long texts are cut into pieces that
are solved for every state before them and then joined.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from parcelspark.llm import pretoken
from parcelspark.llm.textblocks import EMPTIERS, slices

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Texts that the field is fitted to, at most about; a bound of the method.
SAMPLE_DOCS = 1500
#: Segments taken from one sampled text, and tokens in a segment.
SEGMENTS, SEGMENT = 4, 40
MORE = 12
PIECE = 256
#: Sampled texts that get planted examples, at most about; things planted into one of them, secrets and harmless ones.
PLANTED_DOCS, PLANTED = 500, 5
#: Letters of the random secrets of training.
ALPHABETS = ("0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
#: Beginnings of issued keys, words beside secrets, words beside harmless data.
PREFIXES = ("AKIA", "ghp_", "gho_", "glpat-", "sk_live_", "sk-", "xoxb-", "AIza", "eyJ")
SECRET_WORDS = ("key", "pwd", "auth", "bearer", "credential", "private", "pass")
DATA_WORDS = ("base64", "image", "png", "jpeg", "gif", "uuid", "guid", "commit", "version", "isbn", "href", "order", "ticket", "build")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

WORD_TOKEN, MARK_TOKEN = 1, 2
LENGTHS, SHAPES, CHANGES, VARIETY, LEXICAL = 8, 14, 5, 5, 11
#: Feature numbers: own length x shape, own changes x variety, own lexical class; word before, word after, mark before, file.
OWN, MESS, LEX = 0, LENGTHS * SHAPES, LENGTHS * SHAPES + CHANGES * VARIETY
BEFORE = LEX + LEXICAL
AFTER = BEFORE + LEXICAL * SHAPES
MARK = AFTER + LEXICAL * SHAPES
FILE = MARK + LEXICAL
SIZE = FILE + 9


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern matches, leftmost and not overlapping within a kind."""
    if not text:
        return []
    found = []
    low = text.lower() if ("=" in text or ":" in text) else ""
    if low and any(word in low for word in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _path(plain: str) -> bool:
    """Whether a token reads as a path or a file name: parts that are words, joined by strokes, or a short last part."""
    parts = re.split(r"[/]", plain)
    words = sum(p.isalpha() or p.replace(".", "").replace("-", "").replace("_", "").isalpha() for p in parts)
    return len(parts) > 1 and words * 2 >= len(parts) and max(map(len, parts)) < 24


def token_features(token: str) -> tuple[int, int, int, int]:
    """Own length x shape, changes x variety, lexical class, and shape alone."""
    n = len(token)
    length = 0 if n < 2 else 1 if n < 4 else 2 if n < 6 else 3 if n < 9 else 4 if n < 16 else 5 if n < 24 else 6 if n < 40 else 7
    if not (token[0].isalnum() or token[0] in "+/_.-"):
        kind = 1 if "=" in token else 2 if ":" in token else 3 if token[0] in "\"'`" else 4
        return OWN + length * SHAPES, MESS, LEX + kind, 0
    plain = token.strip("._-+/")
    ascii_ = plain.isascii()
    digit, lower, upper = (any(map(test, plain)) for test in (str.isdigit, str.islower, str.isupper))
    if not plain:
        shape = 1
    elif not ascii_:
        shape = 2
    elif not digit:
        inner = not plain.isalpha()
        shape = 13 if inner else 3 if not upper else 4 if not lower else 5 if plain[0].isupper() and plain[1:].islower() else 6
    elif not lower and not upper:
        shape = 7
    else:
        hexes = set(plain) <= set("0123456789abcdef"), set(plain) <= set("0123456789ABCDEF")
        shape = 8 if hexes[0] else 9 if hexes[1] else 10 if not upper else 11 if not lower else 12
    changes = sum(a.isdigit() != b.isdigit() or (a.isupper() and b.islower()) or (a.islower() and b.isupper()) for a, b in zip(plain, plain[1:])) if shape > 4 else 0
    turns = 0 if not changes else 1 if changes == 1 else 2 if changes < 4 else 3 if changes < 8 else 4
    unlike = len(set(plain))
    variety = 0 if unlike < 4 else 1 if unlike < 7 else 2 if unlike < 10 else 3 if unlike < 14 else 4
    low = plain.lower()
    if any(k in low for k in KEYWORDS):
        lexical = 5
    elif plain.startswith(PREFIXES):
        lexical = 7
    elif UUID.fullmatch(plain):
        lexical = 9
    elif n < 16 and any(k in low for k in DATA_WORDS):
        lexical = 10
    elif n < 16 and any(k in low for k in SECRET_WORDS):
        lexical = 6
    else:
        lexical = 8 if plain[:4] in ("http", "www.") or token.startswith("//") or _path(plain) else 0
    return OWN + length * SHAPES + shape, MESS + turns * VARIETY + variety, LEX + lexical, shape


class TokenTable:
    """Features of tokens by hash, filled as tokens come; a full table begins anew."""

    def __init__(self, most: int = 250_000):
        self.most = most
        self.clear()
        EMPTIERS.append(self.clear)

    def clear(self) -> None:
        self.known, self.rows = {}, np.zeros((1024, 4), np.int16)

    def rows_of(self, hashes: np.ndarray, texts: str, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        known = self.known
        slots = np.fromiter((known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            base, at = len(known), first[new]
            made = np.array([token_features(texts[a : a + n]) for a, n in zip(begins[at].tolist(), sizes[at].tolist())], np.int16)
            if base + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(new), len(self.rows)), 4), np.int16)])
            self.rows[base : base + len(new)] = made
            slots[new] = np.arange(base, base + len(new))
            known.update(zip(distinct[new].tolist(), slots[new].tolist()))
        return self.rows[slots[inverse]]


@dataclass
class Tokens:
    """Tokens of several texts: place in the text, text number, and feature numbers (tokens x 7, last columns the neighbours')."""

    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    features: np.ndarray


_process: dict[str, object] = {}


def tokens_of(texts: list[str]) -> Tokens:
    """Runs of word characters and runs of marks, with their features."""
    if not _process:
        kinds = pretoken.code_point_classes()
        table = np.full(len(kinds), MARK_TOKEN, np.uint8)
        table[(kinds == pretoken.LETTER) | (kinds == pretoken.NUMBER)] = WORD_TOKEN
        table[[ord(c) for c in "+/_.-"]] = WORD_TOKEN
        table[(kinds == pretoken.SPACE)] = 0
        table[0] = 0
        _process.update(classes=table, features=TokenTable())
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = _process["classes"][points]
    # a text's own boundary, whatever characters it holds
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(lengths + 1) - lengths - 1
    starts = np.flatnonzero((kinds > 0) & (np.concatenate([np.zeros(1, np.uint8), kinds[:-1]]) != kinds))
    stops = np.flatnonzero((kinds > 0) & (np.concatenate([kinds[1:], np.zeros(1, np.uint8)]) != kinds)) + 1
    if not len(starts):
        return Tokens(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, 7), np.int16))
    solid = points[kinds > 0]
    sizes = stops - starts
    hashes = pretoken.piece_hashes(solid, np.cumsum(sizes) - sizes, sizes)
    own = _process["features"].rows_of(hashes, joined, starts, sizes)
    text = np.searchsorted(offsets, starts, side="right") - 1
    n = len(starts)
    word = kinds[starts] == WORD_TOKEN
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(word, place, -1))
    before = np.concatenate([[-1], last[:-1]])
    nexts = np.minimum.accumulate(np.where(word, place, n)[::-1])[::-1]
    after = np.concatenate([nexts[1:], [n]])
    before = np.where((before >= 0) & (text[before] == text), before, -1)
    after = np.where((after < n) & (text[np.minimum(after, n - 1)] == text), after, -1)
    ahead = np.concatenate([[-1], place[:-1]])
    mark = np.where((ahead >= 0) & (text[ahead] == text) & ~word[ahead], own[ahead, 2] - LEX, 0)
    neighbour = lambda at, base: np.where(at >= 0, base + (own[at, 2] - LEX) * SHAPES + own[at, 3], base)
    marks_in = np.bincount(text[~word], minlength=len(texts)) / np.maximum(np.bincount(text, minlength=len(texts)), 1)
    count = np.bincount(text, minlength=len(texts))
    file = FILE + np.digitize(marks_in, (0.05, 0.3)) * 3 + np.digitize(count, (100, 1000))
    features = np.column_stack([own[:, 0], own[:, 1], own[:, 2], neighbour(before, BEFORE), neighbour(after, AFTER), MARK + mark, file[text]]).astype(np.int16)
    return Tokens(starts - offsets[text], stops - offsets[text], text, features)


@dataclass
class CrfModel:
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # 3 x 3, from state to state; a text begins after an outside token


#: An inside token follows a begin or inside token only.
FORBIDDEN = np.array([[0, 0, 0], [0, 0, 0], [0, -1e6, 0]], np.float64)


def fit(features: np.ndarray, tags: np.ndarray, real: np.ndarray, rounds: int = 80, rate: float = 0.2, l2: float = 1e-4) -> CrfModel:
    """Maximum likelihood for segments (segments x tokens x 7) with tags and a mask of real tokens; Adam on the exact gradient."""
    weights, moves = np.zeros((SIZE, 3)), np.zeros((3, 3))
    if not len(features):
        weights[:, OUTSIDE] = 1
        return CrfModel(weights, FORBIDDEN.copy())
    n, length, width = features.shape
    flat = features.reshape(-1, width)
    hot = np.eye(3)[tags] * real[..., None]
    state = {"m": [np.zeros_like(weights), np.zeros_like(moves)], "v": [np.zeros_like(weights), np.zeros_like(moves)]}
    weight_of = np.where(real.any(1), 1.0, 0.0).sum()
    seen = np.zeros((3, 3))
    pairs = real[:, 1:] & real[:, :-1]
    np.add.at(seen, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    np.add.at(seen, (np.full(n, OUTSIDE), tags[:, 0]), real[:, 0])
    add = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
    for step in range(1, rounds + 1):
        emit = weights[flat].sum(1).reshape(n, length, 3)
        move = moves + FORBIDDEN
        forward, backward = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        forward[0] = emit[:, 0] + move[OUTSIDE]
        for t in range(1, length):
            forward[t] = np.where(real[:, t, None], add(forward[t - 1][:, :, None] + move, 1) + emit[:, t], forward[t - 1])
        for t in range(length - 2, -1, -1):
            backward[t] = np.where(real[:, t + 1, None], add(move + (emit[:, t + 1] + backward[t + 1])[:, None, :], 2), backward[t + 1])
        total = add(forward[-1], 1)
        share = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2) * real[..., None]
        expected = np.zeros((3, 3))
        for t in range(1, length):
            joint = forward[t - 1][:, :, None] + move + (emit[:, t] + backward[t])[:, None, :] - total[:, None, None]
            expected += (np.exp(joint) * real[:, t, None, None]).sum(0)
        expected[OUTSIDE] += share[:, 0].sum(0)
        wrong = ((share - hot) / weight_of).reshape(-1, 3)
        grad_w = np.column_stack([np.bincount(flat.ravel(), np.repeat(wrong[:, k], width), SIZE) for k in range(3)]) + l2 * weights
        grad_m = (expected - seen) / weight_of + l2 * moves
        for k, (value, grad) in enumerate(((weights, grad_w), (moves, grad_m))):
            state["m"][k] = 0.9 * state["m"][k] + 0.1 * grad
            state["v"][k] = 0.99 * state["v"][k] + 0.01 * grad * grad
            value -= rate * (state["m"][k] / (1 - 0.9**step)) / (np.sqrt(state["v"][k] / (1 - 0.99**step)) + 1e-8)
    return CrfModel(weights, moves + FORBIDDEN)


def viterbi(emit: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of several sequences that stand one after the other in ``emit`` (tokens x 3).

    Sequences are cut into pieces; every piece is solved for each of the three states before it,
    then the pieces of a sequence are joined in order and traced back.
    """
    counts = counts[counts > 0]
    if not len(counts):
        return np.zeros(0, np.int8)
    per = -(-counts // PIECE)
    owner = np.repeat(np.arange(len(counts)), per)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    lengths = np.minimum(counts[owner] - rank * PIECE, PIECE)
    starts = (np.cumsum(counts) - counts)[owner] + rank * PIECE
    depth = int(lengths.max())
    order = np.argsort(-lengths, kind="stable")  # longest first: pieces still running are a prefix
    starts, lengths = starts[order], lengths[order]
    n = len(starts)
    running = np.searchsorted(-lengths, -np.arange(depth), side="left")
    moves = moves.astype(np.float32)
    best = moves[None] + emit[starts].astype(np.float32)[:, None, :]
    back = np.zeros((depth, n, 3, 3), np.uint8)
    for t in range(1, depth):
        m = running[t]
        if m == 0:
            break
        now = best[:m]
        top, arg = now[:, :, 0, None] + moves[0], np.zeros((m, 3, 3), np.uint8)
        for k in (1, 2):
            other = now[:, :, k, None] + moves[k]
            better = other > top
            arg[better] = k
            top = np.where(better, other, top)
        best[:m] = top + emit[starts[:m] + t].astype(np.float32)[:, None, :]
        back[t, :m] = arg
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.cumsum(per) - per
    score = np.full((len(counts), 3), -1e30, np.float32)
    score[:, OUTSIDE] = 0
    came = np.zeros((n, 3), np.uint8)
    for j in range(int(per.max())):
        some = np.flatnonzero(per > j)
        at = place[first[some] + j]
        joined = score[some][:, :, None] + best[at]
        came[at] = joined.argmax(1)
        score[some] = joined.max(1)
        score[some] -= score[some].max(1, keepdims=True)
    end, enter = np.zeros(n, np.int64), np.zeros(n, np.int64)
    state = score.argmax(1)
    for j in range(int(per.max()) - 1, -1, -1):
        some = np.flatnonzero(per > j)
        at = place[first[some] + j]
        end[at] = state[some]
        enter[at] = came[at, state[some]]
        state[some] = enter[at]
    tags = np.empty(len(emit), np.int8)
    now = end.copy()
    for t in range(depth - 1, -1, -1):
        m = running[t] if t else n
        if m == 0:
            continue
        tags[starts[:m] + t] = now[:m]
        now[:m] = back[t, np.arange(m), enter[:m], now[:m]] if t else now[:m]
    return tags


def _tags(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of word tokens inside the spans of each text."""
    tags = np.full(len(tokens.begins), OUTSIDE, np.int8)
    edges = np.searchsorted(tokens.text, np.arange(len(spans) + 1))
    for k, own in enumerate(spans):
        for a, b in own:
            lo = edges[k] + np.searchsorted(tokens.begins[edges[k] : edges[k + 1]], a)
            hi = edges[k] + np.searchsorted(tokens.begins[edges[k] : edges[k + 1]], b)
            if hi > lo:
                tags[lo], tags[lo + 1 : hi] = BEGIN, INSIDE
    return tags


def _value_spans(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: the assigned value, or the whole match."""
    out = []
    for a, b, kind in base_spans(text):
        out.append((ASSIGN.match(text, a).start(2), b) if kind == 0 else (a, b))
    out.sort()
    kept: list[tuple[int, int]] = []
    for a, b in out:
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    return kept


def random_secret(draw: random.Random) -> str:
    """A secret of one of several kinds; most are matched by no pattern."""
    run = lambda letters, low, high: "".join(draw.choices(letters, k=draw.randint(low, high)))
    alnum = string.ascii_letters + string.digits
    kind = draw.randrange(8)
    if kind < 4:
        return run(ALPHABETS[draw.randrange(len(ALPHABETS))], 20, 44)
    if kind == 4:
        return draw.choice(PREFIXES[1:]) + run(alnum, 20, 40)
    if kind == 5:  # a signed web token
        return ".".join(("eyJ" + run(alnum, 16, 30), run(alnum + "-_", 24, 60), run(alnum + "-_", 30, 43)))
    if kind == 6:  # lines of a private key
        return "\n".join([run(ALPHABETS[2], 64, 64) for _ in range(draw.randint(2, 6))] + [run(ALPHABETS[2], 12, 60) + "=" * draw.randrange(3)])
    return run(alnum, 8, 14) + draw.choice("!$%#&") + run(alnum, 8, 14)


def random_harmless(draw: random.Random) -> str:
    """Text that looks like a secret and is none; runs of 24 lower-case hexadecimal digits are left to the patterns."""
    run = lambda letters, low, high: "".join(draw.choices(letters, k=draw.randint(low, high)))
    low, alnum = string.ascii_lowercase, string.ascii_letters + string.digits
    word = lambda: run(low, 3, 9)
    kind = draw.randrange(10)
    if kind == 0:
        hexes = lambda k: run("0123456789abcdef", k, k)
        made = "-".join((hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)))
        return made.upper() if draw.random() < 0.3 else made
    if kind == 1:
        return f"https://{word()}.{draw.choice(('com', 'org', 'net'))}/{word()}/{run(alnum, 8, 40)}"
    if kind == 2:
        return f"data:image/{draw.choice(('png', 'jpeg', 'gif'))};base64," + run(alnum + "+/", 40, 300)
    if kind == 3:
        return "".join(word().capitalize() for _ in range(draw.randint(3, 6)))
    if kind == 4:
        return run(low, 20, 45)
    if kind == 5:
        return f"{draw.choice(('ORD', 'INV', 'REF', 'SKU', 'ID'))}-{draw.randint(1990, 2030)}-{draw.randrange(10**6):06d}"
    if kind == 6:
        return f"/{word()}/{word()}/{word()}_{draw.randrange(1000)}.{draw.choice(('txt', 'png', 'html'))}"
    if kind == 7:
        return f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}T{draw.randrange(24):02d}:{draw.randrange(60):02d}:00Z"
    if kind == 8:
        return f"commit {run('0123456789abcdef', 7, 12)}"
    return run(string.digits, 6, 20)


def plant(text: str, draw: random.Random, count: int = PLANTED) -> tuple[str, list[tuple[int, int]], list[int]]:
    """Text with ``count`` secrets and harmless tokens put in at white space: the new text, the secrets' spans, all places."""
    cuts = sorted(draw.randrange(len(text) + 1) for _ in range(count))
    parts, spans, places, size, done = [], [], [], 0, 0

    def add(piece: str) -> None:
        nonlocal size
        parts.append(piece)
        size += len(piece)

    for cut in cuts:
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        cut = max(cut, done)
        add(text[done:cut])
        done = cut
        places.append(size)
        if draw.random() < 0.5:
            add(draw.choice((" ", " ", "\n", " (", ' "', " id ", " see ")) + random_harmless(draw) + draw.choice((" ", ". ", "\n", ") ")))
            continue
        add(draw.choice((" ", " ", " ", "\n", " bearer ", " aws_key ", " key: ", " the key is ", ' "', " (", " = ", " pwd=", " login with ", " use ")))
        secret = random_secret(draw)
        if "\n" in secret:
            add("-----BEGIN PRIVATE KEY-----\n" if draw.random() < 0.7 else "")
        begin = size
        add(secret)
        spans.append((begin, size))
        add(draw.choice((" ", " ", ". ", ", ", "\n", '" ', ") ")))
    add(text[done:])
    return "".join(parts), spans, places


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_docs: int = SAMPLE_DOCS, planted_docs: int = PLANTED_DOCS) -> CrfModel:
    """Field fitted to segments of about ``sample_docs`` texts, chosen by a hash of id and text.

    Each of them gives a segment of the text as it is; about ``planted_docs`` of them also those around what ``plant`` puts in. Of texts with a secret of the
    patterns, which are few, MORE times that share is used, with segments around the first secrets.
    Rows with equal id and text count once. No texts: the field tags nothing.
    """
    rows = docs.select(F.coalesce(docs[id_column].cast("string"), F.lit("")).alias("id"), docs[text_column].alias("text")).filter("text is not null and text <> ''")
    total = max(rows.count(), 1)
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    limit, plants = (int(min(1.0, wanted / total) * (1 << 30)) for wanted in (sample_docs, planted_docs))
    chosen = rows.withColumn("place", place).filter(F.col("place") <= limit * MORE).dropDuplicates(["place"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = {"place": [], "number": [], "features": [], "tags": []}
            texts, places = batch.column("text").to_pylist(), batch.column("place").to_pylist()
            own = [_value_spans(t) for t in texts]
            keep = [k for k, spot in enumerate(places) if spot <= limit or own[k]]
            for k in keep:
                spot, number = places[k], 0

                def take(tokens: Tokens, tags: np.ndarray, begins: list[int], disguise: bool) -> None:
                    nonlocal number
                    for a in begins:
                        b = min(a + SEGMENT, len(tags))
                        features = tokens.features[a:b].copy()
                        if disguise and (spot + number) % 3 == 0:  # hide the pattern's keyword
                            features[features[:, 2] == LEX + 5, 2] = LEX
                            near = (features[:, 3] - BEFORE) // SHAPES == 5
                            features[near, 3] -= 5 * SHAPES
                        elif disguise and (spot + number) % 3 == 1:
                            draw = random.Random(spot + number)
                            for at in np.flatnonzero(tags[a:b] != OUTSIDE).tolist():
                                features[at, :3] = token_features("".join(draw.choices(draw.choice(ALPHABETS), k=draw.randint(16, 44))))[:3]
                        for name, value in zip(out, (spot, number, features.tobytes(), tags[a:b].tobytes())):
                            out[name].append(value)
                        number += 1

                tokens = tokens_of([texts[k]])
                n = len(tokens.begins)
                if not n:
                    continue
                tags = _tags(tokens, [own[k]])
                hits = np.flatnonzero(tags == BEGIN).tolist()
                take(tokens, tags, [max(0, h - (spot >> 3) % (SEGMENT // 2) - 4) for h in hits[: SEGMENTS - 1]] + [spot % max(n - SEGMENT, 1)], True)
                if spot <= plants:
                    made, spans, at = plant(texts[k], random.Random(spot))
                    tokens = tokens_of([made])
                    clear = [(a, b) for a, b in _value_spans(made) if not any(a < d and c < b for c, d in spans)]
                    tags = _tags(tokens, [sorted(spans + clear)])
                    first = np.searchsorted(tokens.begins, at).tolist()
                    take(tokens, tags, [max(0, f - 4 - (spot >> j) % (SEGMENT // 2)) for j, f in enumerate(first)], False)
            yield pa.RecordBatch.from_arrays([pa.array(out["place"], pa.int64()), pa.array(out["number"], pa.int32()), pa.array(out["features"], pa.binary()),
                                              pa.array(out["tags"], pa.binary())], names=list(out))

    found = chosen.select("place", "text").mapInArrow(segments, "place long, number int, features binary, tags binary").collect()
    found.sort(key=lambda row: (row.place, row.number, row.features))
    features = np.zeros((len(found), SEGMENT, 7), np.int16)
    tags, real = np.full((len(found), SEGMENT), OUTSIDE, np.int64), np.zeros((len(found), SEGMENT), bool)
    for k, row in enumerate(found):
        own = np.frombuffer(row.tags, np.int8)
        features[k, : len(own)] = np.frombuffer(row.features, np.int16).reshape(-1, 7)
        tags[k, : len(own)], real[k, : len(own)] = own, True
    if not (tags == BEGIN).any():
        return fit(features[:0], tags[:0], real[:0])
    # a segment may begin inside a secret
    tags[:, 0] = np.where(tags[:, 0] == INSIDE, BEGIN, tags[:, 0])
    return fit(features, tags, real)


def find_spans(texts: list[str | None], model: CrfModel) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind number) of every text: all base spans, and those of the field that do not lie inside one of them."""
    texts = [text or "" for text in texts]
    found = [base_spans(text) for text in texts]
    tokens = tokens_of(texts)
    if not len(tokens.begins):
        return found
    weights = model.weights.astype(np.float32)
    emit = weights[tokens.features[:, 0]]
    for k in range(1, tokens.features.shape[1]):
        emit += weights[tokens.features[:, k]]
    counts = np.bincount(tokens.text, minlength=len(texts))
    tags = viterbi(emit, counts, model.moves)
    for at in np.flatnonzero(tags == BEGIN).tolist():
        stop = at + 1
        while stop < len(tags) and tags[stop] == INSIDE and tokens.text[stop] == tokens.text[at]:
            stop += 1
        span = int(tokens.begins[at]), int(tokens.ends[stop - 1])
        own = found[tokens.text[at]]
        if not any(a <= span[0] and span[1] <= b for a, b, kind in own if kind < 3):
            own.append((*span, 3))
    return [sorted(own, key=lambda s: (s[0], s[2])) for own in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, model: CrfModel, text_column: str = "text") -> DataFrame:
    """The input's columns with n_assign, n_access, n_hex, base_sha256, spans and ``redacted``.

    ``redacted`` is the text with every span (overlapping ones united) replaced by ``[SECRET]``; null stays null.
    A null or empty text has no spans. Input columns of these names are replaced. Rows stay as they are.
    """
    new = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "redacted")]
    docs = docs.drop(*(field.name for field in new))
    schema = T.StructType([*docs.schema.fields, *new])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text_column):
            texts = batch.column(text_column).to_pylist()
            every = find_spans(texts, model)
            counts = [[sum(kind == k for _, _, kind in spans) for spans in every] for k in range(3)]
            digests = [hashlib.sha256(joined([s for s in spans if s[2] < 3]).encode()).hexdigest() for spans in every]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                pa.array([joined(spans) for spans in every], pa.string()), pa.array([redact(t, s) for t, s in zip(texts, every)], pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Text with the spans replaced; spans that overlap are one."""
    if not spans:
        return text
    parts, done = [], 0
    for a, b, _ in spans:
        if a >= done:
            parts += [text[done:a], "[SECRET]"]
        done = max(done, b)
    return "".join(parts) + text[done:]
