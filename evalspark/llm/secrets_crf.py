"""Secret scan: base patterns, and a linear-chain conditional random field for what they miss.

Tokens of a line are tagged as begin, inside or outside of a secret. A tag's score comes from the
token's shape, the words or shapes of its neighbours and features of the whole file; the best
sequence is decoded by Viterbi. Spans found that way are added to the spans of the base patterns
where they do not overlap; base spans always stay.

The model is fitted by maximum likelihood on `TRAINING_LINES` generated lines from a fixed seed, a
bounded set whatever the table's size. A line in which no token can gain from a tag other than
outside, whatever its neighbours get, is not decoded; that cannot change the result.

Null and empty texts have no spans. Positions are code points, ends exclusive. Other columns are
not read; equal rows have equal spans.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from evalspark.llm.batches import map_texts

#: Generated lines the model is fitted on, and rounds of fitting.
TRAINING_LINES = 1500
ROUNDS = 120
SEED = 7
REMEMBERED = 400_000
#: Tokens of lines of like length that are decoded together.
LINE_TOKENS = 1 << 17
#: Characters that a span of the model has at least, as the values of the base patterns.
MIN_CHARS = 6

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[\w+/=-]+(?:\.[\w+/=-]+)*|[^\w+/=-]")
#: Where an unquoted assignment ends inside a token: TOKEN=value.
INNER = re.compile(r"=(?!=*$)")

# Words the model knows by themselves.
KEYWORDS = frozenset(
    "password passwd pwd pass passphrase secret secrets token key apikey api auth authorization "
    "bearer basic credential credentials private access client login user username id uuid guid "
    "sha sha1 sha256 md5 commit revision hash checksum etag version build release serial order "
    "number phone isbn ref page date time the a of is to and in my your for with new old this that "
    "export set curl http https ssh host port url name value count length size type file path "
    "none null true false default example changeme input getenv environ".split()
)
PREFIXES = ("ghp_", "gho_", "sk-", "sk_live_", "pk_live_", "xox", "eyJ", "AKIA", "glpat-", "SG.")

# ---- features ----


def shape(token: str) -> str:
    if token.isalpha():
        if token.islower():
            return "a"
        if token.isupper():
            return "A"
        return "Aa" if token[1:].islower() else "aA"
    if token.isdigit():
        return "9"
    lower = any(c.islower() for c in token)
    upper = any(c.isupper() for c in token)
    digit = any(c.isdigit() for c in token)
    other = any(not c.isalnum() for c in token)
    return "a" * lower + "A" * upper + "9" * digit + "-" * other


def size_class(token: str) -> int:
    return bisect.bisect_right((2, 4, 6, 8, 12, 16, 20, 28, 36), len(token))


def features(token: str) -> tuple:
    """What tells tokens apart: word, shape, size, variety of characters, share of digits, prefix."""
    word = token.lower() if len(token) < 24 else ""
    word = word if word in KEYWORDS or len(token) == 1 and not token.isalnum() else ""
    if token.isalpha():
        return word, shape(token), size_class(token), -1, -1, ""
    n = len(token)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
    digits = sum(c.isdigit() for c in token)
    prefix = next((p for p in PREFIXES if token.startswith(p)), "")
    parts = re.split(r"[^A-Za-z]+", token.lower())
    if not word and any(p in KEYWORDS for p in parts if len(p) > 2):
        word = "with " + next(p for p in parts if len(p) > 2 and p in KEYWORDS)
    return word, shape(token), size_class(token), int(entropy * 1.5), 4 * digits // n, prefix


def own_names(kind: tuple) -> list[str]:
    word, form, size, entropy, digits, prefix = kind
    names = [f"w {word}", f"s {form}", f"l {size}", f"e {entropy}", f"d {digits}", f"p {prefix}"]
    return [*names, f"sl {form} {size}", f"se {form} {entropy}", f"le {size} {entropy}", "bias"]


def near_names(kind: tuple) -> list[str]:
    word, form, size = kind[:3]
    return [f"w {word}" if word else f"s {form} {size > 3}"]


ROLES = {"own": 0, "before": -1, "before2": -2, "after": 1}
EDGE = ("<edge>", "", 0, 0, 0, "")


def names_in(role: str, kind: tuple) -> list[str]:
    return [f"{role} {n}" for n in (own_names(kind) if role == "own" else near_names(kind))]


def file_class(text: str) -> int:
    """0 to 5: how much a text looks like code, and whether it names a secret."""
    marks = sum(map(text.count, "={};"))
    code = 0 if not marks else 1 if 200 * marks < len(text) else 2
    low = text.lower()
    return 2 * code + any(w in low for w in ("password", "secret", "token", "key", "pwd"))


# ---- training lines ----


def _secret(rng: random.Random) -> str:
    any_of = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    alnum = string.ascii_letters + string.digits
    return rng.choice(
        [
            lambda: any_of("0123456789abcdef", 12, 40),
            lambda: any_of(alnum, 10, 40),
            lambda: any_of(alnum + "+/", 16, 44) + "=" * rng.randint(0, 2),
            lambda: rng.choice(PREFIXES) + any_of(alnum, 16, 36),
            lambda: any_of(string.ascii_lowercase, 3, 8).title() + any_of("0123456789", 2, 4)
            + any_of("!$%&*", 1, 1) + any_of(alnum, 0, 5),
        ]
    )()


def _prose(rng: random.Random, n: int) -> list[str]:
    syllables = "an er th on re he in ed nd ha at en es of or nt ea ti to ión qué é au ß ü äch ung".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(n)]
    words = [rng.choice(["the", "of", "is", "and", "to", "my", "this", w, w, w]) for w in words]
    if rng.random() < 0.15:
        form = rng.choice([str.upper, lambda w: w[0].upper(), lambda w: w[:2].upper() + w[2:]])
        words = [form(w) for w in words]
    return [w.title() if rng.random() < 0.1 else w + rng.choice(["", "", "", ",", "."]) for w in words]


def _number(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    h = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    return rng.choice(
        [
            lambda: d(16), lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: d(rng.randint(1, 12)),
            lambda: ".".join(d(rng.randint(1, 3)) for _ in range(4)), lambda: f"{d(4)}-{d(2)}-{d(2)}",
            lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"jo.{d(2)}@mail{d(1)}.example.com",
            lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", lambda: f"{d(2)}:{d(2)}", lambda: d(3) + "%",
            lambda: f"commit {h(rng.choice([7, 8, 12, 40]))}", lambda: f"sha256: {h(rng.choice([16, 40]))}",
            lambda: f"https://www.example.com/{h(6)}/index.html", lambda: f"uuid = {h(20)}",
            lambda: f"etag {h(16)}", lambda: f"build {h(12)}",
        ]
    )()


def training_line(rng: random.Random) -> tuple[str, list[tuple[int, int]], int]:
    """A line, the spans of its secrets and the class of its file."""
    kind = rng.random()
    file = rng.choice([0, 1, 2, 3, 4, 5])
    around = lambda: " ".join(_prose(rng, rng.randint(0, 8)))
    if kind < 0.5:
        names = "password passwd pwd pass passphrase secret client_secret token auth_token access_token api_key apikey private_key db_password credentials auth".split()
        key = rng.choice(names)
        key = rng.choice([key, key.upper(), key.title(), "my " + key, "new " + key])
        quote = rng.choice(["", "", '"', "'"])
        before, after = rng.choice(
            [
                (f"{key} = {quote}", quote), (f"{key}={quote}", quote), (f"{key}: {quote}", quote),
                (f"{key} is ", ""), ("Authorization: Bearer ", '"'), (f"--{key} ", ""),
                (f"{key} => {quote}", quote), ("https://user:", "@host.example.com/"),
                (f'"{key}": "', '",'), (f"export {key}=", ""), (f"{key} ", ""),
                (f'curl -H "X-Api-Key: ', '" https://api.example.com'), (f"{key} -> ", ";"),
            ]
        )
        lead = f"{around()} {before}".lstrip() if rng.random() < 0.5 else before
        secret = _secret(rng)
        tail = rng.choice(["", f" {around()}", f". {around()}"])
        return lead + secret + after + tail, [(len(lead), len(lead) + len(secret))], file
    if kind < 0.65:
        return rng.choice(
            [
                "token = tokenizer.next_token()", "password = input(prompt)", "secret = None",
                "if password is None: return", "token count: 512", "key: value", "api_key = None",
                "the secret of the garden", "api_key = os.environ[API_KEY]", "access to the file",
                "a token of my love", "for key in keys: print(key)", "PASSWORD = getenv(PWD)",
                "password: changeme", "my key is here", "pass the salt to him", "token is missing",
            ]
        ) + rng.choice(["", " " + around()]), [], file
    words = _prose(rng, rng.randint(3, 24))
    for _ in range(rng.choice([0, 0, 1, 2])):
        words.insert(rng.randrange(len(words)), _number(rng))
    return " ".join(words), [], rng.choice([0, 0, 1, 1, 2, 3])


def split_tokens(line: str) -> list[tuple[int, int]]:
    """Bounds of the tokens of a line; a token NAME=value is cut behind its sign."""
    found = []
    for m in TOKEN.finditer(line):
        if not m.group().isspace():
            cut = INNER.search(m.group())
            if cut:
                middle = m.start() + cut.end()
                found += [(m.start(), middle), (middle, m.end())]
            else:
                found.append(m.span())
    return found


# ---- the model ----

OUT, BEGIN, INSIDE = range(3)
NEVER = -1e6


def forward(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-sums of all paths to each tag; (line, token, tag)."""
    out = np.empty_like(scores)
    out[:, 0] = scores[:, 0] + np.array([0, 0, NEVER])
    for t in range(1, scores.shape[1]):
        paths = out[:, t - 1, :, None] + moves
        top = paths.max(axis=1)
        out[:, t] = scores[:, t] + top + np.log(np.exp(paths - top[:, None]).sum(axis=1))
    return out


def backward(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros_like(scores)
    for t in range(scores.shape[1] - 2, -1, -1):
        paths = moves + (scores[:, t + 1] + out[:, t + 1])[:, None, :]
        top = paths.max(axis=2)
        value = top + np.log(np.exp(paths - top[:, :, None]).sum(axis=2))
        out[:, t] = np.where((t + 1 < lengths)[:, None], value, 0)
    return out


class Model:
    """Weights by feature name and tag, and moves from tag to tag."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def score(self, names: Sequence[str]) -> np.ndarray:
        return sum((self.weights[n] for n in names if n in self.weights), np.zeros(3))


@functools.cache
def fit(lines: int = TRAINING_LINES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam on all lines at once."""
    rng = random.Random(seed)
    index: dict[str, int] = {}
    rows, tags, sizes = [], [], []
    for _ in range(lines):
        line, spans, file = training_line(rng)
        bounds = split_tokens(line)
        kinds = [features(line[a:b]) for a, b in bounds]
        for i, (a, b) in enumerate(bounds):
            names = [f"file {file}"]
            for role, shift in ROLES.items():
                near = kinds[i + shift] if 0 <= i + shift < len(kinds) else EDGE
                names += names_in(role, near)
            rows.append([index.setdefault(n, len(index)) for n in names])
            span = next((s for s in spans if s[0] <= a < s[1]), None)
            tags.append(OUT if span is None else BEGIN if a == span[0] else INSIDE)
        sizes.append(len(bounds))
    table, gold = np.array(rows), np.array(tags)
    lengths = np.array(sizes)
    line_of = np.repeat(np.arange(lines), lengths)
    place = np.arange(len(gold)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    n, width = len(index), lengths.max()
    weights, moves = np.zeros((n, 3)), np.zeros((3, 3))
    forbidden = np.zeros((3, 3), dtype=bool)
    forbidden[OUT, INSIDE] = True
    moves[forbidden] = NEVER
    follows = place[1:] > 0
    seen_moves = np.zeros((3, 3))
    np.add.at(seen_moves, (gold[:-1][follows], gold[1:][follows]), 1)
    last = lengths - 1
    means = [np.zeros_like(weights), np.zeros_like(moves)]
    squares = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        token_scores = weights[table].sum(axis=1)
        scores = np.zeros((lines, width, 3))
        scores[line_of, place] = token_scores
        a = forward(scores, moves)
        b = backward(scores, moves, lengths)
        end = a[np.arange(lines), last]
        total = np.log(np.exp(end - end.max(axis=1, keepdims=True)).sum(axis=1)) + end.max(axis=1)
        chance = np.exp((a + b)[line_of, place] - total[line_of][:, None])
        chance[np.arange(len(gold)), gold] -= 1
        slope = np.stack(
            [
                np.bincount(table.ravel(), np.repeat(chance[:, k], table.shape[1]), n)
                for k in range(3)
            ],
            axis=1,
        )
        here, before = np.flatnonzero(follows) + 1, np.flatnonzero(follows)
        la, lb = line_of[here], place[here]
        pairs = (
            a[la, place[before]][:, :, None]
            + moves
            + (scores[la, lb] + b[la, lb])[:, None, :]
            - total[la][:, None, None]
        )
        move_slope = np.exp(pairs).sum(axis=0) - seen_moves
        move_slope[forbidden] = 0
        for k, (value, gradient) in enumerate(((weights, slope), (moves, move_slope))):
            gradient = gradient + 0.5 * np.where(np.abs(value) < 1e5, value, 0)
            means[k] = 0.9 * means[k] + 0.1 * gradient
            squares[k] = 0.99 * squares[k] + 0.01 * gradient**2
            move = means[k] / (1 - 0.9**step) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
            value -= 0.1 * (move * ~forbidden if k else move)
    return Model({name: weights[i] for name, i in index.items()}, moves)


# ---- decoding ----


def viterbi(scores: Sequence[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Best tags of some lines; scores are (token, tag). Lines of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(scores)
    groups: dict[int, list[int]] = {}
    for i, own in enumerate(scores):
        groups.setdefault(len(own).bit_length(), []).append(i)
    for bits, members in groups.items():
        step = max(1, LINE_TOKENS >> bits)
        for first in range(0, len(members), step):
            some = members[first : first + step]
            for i, tags in zip(some, _viterbi([scores[i] for i in some], moves)):
                out[i] = tags
    return out


def _viterbi(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    lengths = np.array([len(s) for s in scores])
    width, rows = int(lengths.max()), np.arange(len(scores))
    padded = np.zeros((width, len(scores), 3))
    for i, own in enumerate(scores):
        padded[: len(own), i] = own
    best = padded[0] + np.array([0, 0, NEVER])
    back = np.zeros((width, len(scores), 3), dtype=np.int8)
    last = best.copy()
    for t in range(1, width):
        paths = best[:, :, None] + moves
        back[t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + padded[t]
        last[lengths > t] = best[lengths > t]
    tags = np.zeros((width, len(scores)), dtype=np.int8)
    now = last.argmax(axis=1)
    for t in range(width - 1, -1, -1):
        tags[t, lengths > t] = now[lengths > t]
        now = np.where(lengths > t, back[t, rows, now], now)
    return [tags[: lengths[i], i] for i in rows]


class Scanner:
    """Finds the spans of texts; remembers the features of tokens up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.scores = {role: np.zeros((0, 3)) for role in ROLES}
        self.file = np.array([model.score([f"file {i}"]) for i in range(6)])
        self.edge = self._kind(EDGE)
        gain = model.moves - model.moves[OUT, OUT]
        #: at most this much can a token gain from the moves around it
        self.gain = 2 * max(0.0, gain.max())

    def _kind(self, kind: tuple) -> int:
        if kind not in self.kinds:
            self.kinds[kind] = len(self.kinds)
            for role in ROLES:
                row = self.model.score(names_in(role, kind))
                self.scores[role] = np.vstack((self.scores[role], row))
        return self.kinds[kind]

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > REMEMBERED:
            self.known.clear()
        for token in tokens:
            if token not in self.known:
                self.known[token] = -1 if token.isspace() else self._kind(features(token))

    def added(self, texts: Sequence[str]) -> list[list[tuple[int, int]]]:
        """Spans tagged by the model, per text."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        tokens: list[str] = []
        counts = []
        for text in texts:
            own = TOKEN.findall(text)
            if "=" in text:
                own = [p for t in own for p in _cut(t)]
            tokens += own
            counts.append(len(own))
        if not tokens:
            return found
        self._learn(set(tokens))
        kind = np.array(list(map(self.known.__getitem__, tokens)), dtype=np.int64)
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        text_of = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(size)
        first = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))[:-1].clip(max=len(ends))]
        newline = np.fromiter((t == "\n" for t in tokens), dtype=bool, count=len(tokens))
        line = np.cumsum(newline) + text_of
        real = kind >= 0
        kind, line, text_of = kind[real], line[real], text_of[real]
        stop, size = ends[real], size[real]
        if not len(kind):
            return found
        score = self.scores["own"][kind] + self.file[[file_class(t) for t in texts]][text_of]
        for role, shift in ROLES.items():
            if shift:
                near = np.full(len(kind), self.edge)
                to, of = (slice(-shift, None), slice(None, shift)) if shift < 0 else (
                    slice(None, -shift), slice(shift, None))
                near[to] = np.where(line[to] == line[of], kind[of], self.edge)
                score += self.scores[role][near]
        hopeful = score[:, 1:].max(axis=1) - score[:, OUT] + self.gain > 0
        bounds = []
        for n in np.unique(line[hopeful]).tolist():
            a, b = np.searchsorted(line, (n, n + 1))
            bounds.append((a, b))
        decoded = viterbi([score[a:b] for a, b in bounds], self.model.moves)
        for (a, _), tags in zip(bounds, decoded):
            text = int(text_of[a])
            for i in np.flatnonzero(tags != OUT).tolist():
                end = int(stop[a + i] - first[text])
                if tags[i] == BEGIN:
                    found[text].append((end - int(size[a + i]), end))
                else:
                    found[text][-1] = (found[text][-1][0], end)
        return [[(a, b) for a, b in own if b - a >= MIN_CHARS] for own in found]


def _cut(token: str) -> list[str]:
    cut = INNER.search(token)
    return [token[: cut.end()], token[cut.end() :]] if cut else [token]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(
    df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` and, per row, `kinds` (array of string), `starts` and `ends` (array of
    int), ordered by start and then by kind as in `KINDS`."""

    def make() -> Callable[[list], list]:
        scanner = Scanner(model)

        def run(texts: list) -> list:
            plain = [t or "" for t in texts]
            out = []
            for own, more in zip(map(base_spans, plain), scanner.added(plain)):
                free = [(a, 3, b) for a, b in more if not any(x < b and a < y for x, _, y in own)]
                out.append(sorted(own + free))
            return [
                [[KINDS[k] for _, k, _ in o] for o in out],
                [[a for a, _, _ in o] for o in out],
                [[b for _, _, b in o] for o in out],
            ]

        return run

    fields = {"kinds": "array<string>", "starts": "array<int>", "ends": "array<int>"}
    return map_texts(df, text, make, fields, keep).select("kept.*", "out.*")
