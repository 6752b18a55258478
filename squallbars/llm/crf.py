"""A linear-chain conditional random field over the shapes of tokens, in numpy.

Tokens are runs of letters, runs of digits and single other characters. Each token's features (its shape, its length,
the shapes beside it, whether a blank goes before it) are rows of a weight table; labels are O and B-/I- of each kind.
Training maximises the regularised conditional likelihood by gradient steps over one padded batch; decoding runs Viterbi
over batches of sequences of like length. Whole texts are decoded by tables over shape codes: a bound on what any run of
labels through a token can gain over O proves most tokens O, and Viterbi runs on the others, which gives the same path.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_MARK = re.compile(r"<(\w+)>(.*?)</\1>", re.S)
_KEPT = {"at", "dot", "ext", "tel", "phone", "call", "mobile", "fax", "order", "no", "version", "page", "invoice", "mail", "email", "ip", "host", "card", "visa", "com", "org", "net", "id", "isbn"}

_LONGEST_KEPT = max(map(len, _KEPT))  # a word and its letters in one number: 7 at most


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def shape(token: str) -> str:
    """A token's shape: digit runs by length, letter runs by case, known words and marks as they are."""
    if token[0] in "0123456789":
        return f"d{min(len(token), 20)}"
    if token[0].isalpha():
        low = token.lower()
        return low if low in _KEPT else "X" if token.isupper() else "Xx" if token[0].isupper() else "x"
    return token


def features(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, ...]]:
    """Feature names of each token."""
    shapes = ["<", "<", *(shape(text[a:b]) for a, b in spans), ">", ">"]
    tied = [False, *(spans[i - 1][1] == spans[i][0] for i in range(1, len(spans))), False]
    out = []
    for i in range(len(spans)):
        here, left, right = shapes[i + 2], shapes[i + 1], shapes[i + 3]
        size = "n" + str(int(here[1:]) // 3) if here[0] == "d" and here[1:].isdigit() else "a"
        out.append((f"0{here}", f"-{left}", f"+{right}", f"-2{shapes[i]}", f"+2{shapes[i + 4]}", f"-0{left} {here}", f"0+{here} {right}",
                    f"z{size}", f"t{tied[i]:d}{tied[i + 1]:d}", f"t{tied[i]:d}{here}"))
    return out


def labelled(row: str, kinds: tuple[str, ...]) -> tuple[list[tuple[str, ...]], list[int]]:
    """Features and labels of a row in which spans stand as <kind>...</kind>."""
    text, marks, at = "", [], 0
    for m in _MARK.finditer(row):
        text += row[at:m.start()]
        marks.append((len(text), len(text) + len(m[2]), kinds.index(m[1])))
        text += m[2]
        at = m.end()
    text += row[at:]
    spans = tokens(text)
    labels = [0] * len(spans)
    for a, b, k in marks:
        for i, (s, e) in enumerate(spans):
            if a <= s and e <= b:
                labels[i] = 1 + 2 * k + (s > a)
    return features(text, spans), labels


class ChainField:
    def __init__(self, kinds: tuple[str, ...], names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.kinds, self.names, self.weights, self.moves = kinds, names, weights, moves

    @classmethod
    def train(cls, rows: list[str], kinds: tuple[str, ...], steps: int = 300, penalty: float = 0.02, rate: float = 0.1) -> "ChainField":
        data = [d for d in (labelled(r, kinds) for r in rows) if d[1]]
        names: dict[str, int] = {}
        for fs, _ in data:
            for f in fs:
                for n in f:
                    names.setdefault(n, len(names))
        count, long, size = len(data), max(len(y) for _, y in data), 1 + 2 * len(kinds)
        wide = len(data[0][0][0])
        at = np.full((count, long, wide), len(names))
        gold, mask = np.zeros((count, long), int), np.zeros((count, long), bool)
        for i, (fs, y) in enumerate(data):
            at[i, :len(y)] = [[names[n] for n in f] for f in fs]
            gold[i, :len(y)], mask[i, :len(y)] = y, True
        weights, moves = np.zeros((len(names) + 1, size)), cls._allowed(size)
        params = [weights, moves]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        forbidden = np.isneginf(moves)
        for step in range(1, steps + 1):
            grads = cls._gradient(weights, moves, at, gold, mask)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g - penalty * np.where(np.isneginf(p), 0, p)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            moves[forbidden] = -np.inf
            weights[-1] = 0
        return cls(kinds, names, weights, moves)

    @staticmethod
    def _allowed(size: int) -> np.ndarray:
        """Moves between labels; inside a kind only from its begin or inside. The last row is the start."""
        moves = np.zeros((size + 1, size))
        for to in range(2, size, 2):
            moves[[f for f in range(size + 1) if f not in (to - 1, to)], to] = -np.inf
        return moves

    @staticmethod
    def _gradient(weights, moves, at, gold, mask):
        """Observed less expected counts of features and moves, by forward and backward sums."""
        score = weights[at].sum(2)
        count, long, size = score.shape
        step = np.exp(moves[:size])
        ahead, scale = np.zeros_like(score), np.ones((count, long))
        top = score.max(2, keepdims=True)
        emit = np.exp(score - top)
        ahead[:, 0] = np.exp(moves[size]) * emit[:, 0]
        for t in range(long):
            if t:
                ahead[:, t] = (ahead[:, t - 1] @ step) * emit[:, t]
            scale[:, t] = ahead[:, t].sum(1)
            ahead[:, t] /= scale[:, t, None]
        back = np.ones_like(score)
        last = mask.sum(1) - 1
        pair = np.zeros((size, size))
        for t in range(long - 2, -1, -1):
            live = (t < last)[:, None]
            onward = emit[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]
            pair += np.einsum("nf,ft,nt->ft", np.where(live, ahead[:, t], 0), step, onward)
            back[:, t] = np.where(live, onward @ step.T, 1.0)
        belief = ahead * back
        belief = np.where(mask[..., None], belief / belief.sum(2, keepdims=True), 0)
        belief_gap = np.where(mask[..., None], np.eye(size)[gold], 0) - belief
        grad = np.zeros_like(weights)
        for j in range(at.shape[2]):
            np.add.at(grad, at[:, :, j].ravel(), belief_gap.reshape(-1, size))
        seen = np.zeros_like(moves)
        np.add.at(seen, (np.full(count, size), gold[:, 0]), 1)
        np.add.at(seen, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        seen[:size] -= pair
        seen[size] -= belief[:, 0].sum(0)
        grad[-1] = 0
        return [grad, np.where(np.isneginf(moves), 0, seen)]

    def decode(self, sequences: list[list[tuple[str, ...]]], together: int = 512) -> list[np.ndarray]:
        """The best labels of each sequence."""
        none, size = len(self.names), self.weights.shape[1]
        scores = [self.weights[[[self.names.get(f, none) for f in fs] for fs in s]].sum(1) if s else np.zeros((0, size)) for s in sequences]
        return self._paths(scores, [self.moves[size]] * len(scores), [np.zeros(size)] * len(scores), together)

    def _paths(self, scores: list[np.ndarray], starts: list[np.ndarray], ends: list[np.ndarray], together: int = 512) -> list[np.ndarray]:
        """Viterbi paths through token scores, from a row of moves into each first token and with a row added at each last."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
        order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
        size = self.weights.shape[1]
        while order:
            most = max(1, min(together, 200_000 // len(scores[order[-1]])))
            some, order = order[-most:], order[:-most]
            n = np.array([len(scores[i]) for i in some])
            score = np.zeros((len(some), n.max(), size))
            for row, i in enumerate(some):
                score[row, :n[row]] = scores[i]
                score[row, n[row] - 1] += ends[i]
            best = np.array([starts[i] for i in some]) + score[:, 0]
            came = np.zeros((len(some), n.max(), size), np.int8)
            for t in range(1, n.max()):
                paths = best[:, :, None] + self.moves[:size]
                came[:, t] = paths.argmax(1)
                best = np.where((t < n)[:, None], paths.max(1) + score[:, t], best)
            label, path = best.argmax(1), np.zeros((len(some), n.max()), int)
            rows = np.arange(len(some))
            for t in range(n.max() - 1, -1, -1):
                label = np.where(t == n - 1, best.argmax(1), label)
                path[:, t] = label
                label = np.where(t < n, came[rows, t, label], label)
            for row, i in enumerate(some):
                out[i] = path[row, :n[row]]
        return out

    def text_decoder(self) -> "TextDecoder":
        return TextDecoder(self)


_BLANK, _LETTER, _DIGIT, _SINGLE = range(4)


def _character_tables() -> dict[str, np.ndarray]:
    """What `_TOKEN` and `shape` ask of a character, for every character of the basic plane."""
    plane = [chr(i) for i in range(1 << 16)]
    kind = [_BLANK if c.isspace() else _DIGIT if c in "0123456789" else _LETTER if c.isalnum() and not c.isdecimal() else _SINGLE for c in plane]
    ascii_low = np.full(1 << 16, 255, np.int64)
    for c in range(26):
        ascii_low[[65 + c, 97 + c]] = 97 + c
    return {"kind": np.array(kind, np.int8), "alpha": np.array([c.isalpha() for c in plane]), "upper": np.array([c.isupper() for c in plane]),
            "lower": np.array([c.islower() or unicodedata.category(c) == "Lt" for c in plane]), "ascii": ascii_low}


class TextDecoder:
    """Labels of whole texts. Shapes that no feature names share one code, so the tables stay small.

    Texts are cut and shapes are told by tables over characters, a whole text at a time; a text with characters beyond the
    basic plane is cut token by token, with the same result.
    """

    def __init__(self, field: ChainField):
        self.field = field
        self.tables = _character_tables()
        known = {n[1:] for n in field.names if n[0] == "0" and " " not in n}
        shapes = ["<", ">", *(f"d{k}" for k in range(1, 21)), *sorted(known | _KEPT | {"x", "X", "Xx"}), "\0"]
        self.shapes = {s: i for i, s in reversed(list(enumerate(shapes)))}
        self.other = len(shapes) - 1
        self.single = np.full(1 << 16, self.other)
        for mark, code in self.shapes.items():
            if len(mark) == 1 and ord(mark) < 1 << 16:
                self.single[ord(mark)] = code
        self.runs = np.array([self.shapes[f"d{k}"] for k in range(1, 21)])
        words = sorted((sum(ord(c) << 8 * i for i, c in enumerate(w)), self.shapes[w]) for w in _KEPT)
        self.words, self.word_codes = np.array([w for w, _ in words]), np.array([c for _, c in words])
        zero = np.zeros(field.weights.shape[1])
        w = lambda n: field.weights[field.names[n]] if n in field.names else zero
        z = lambda s: w("z" + ("n" + str(int(s[1:]) // 3) if s[0] == "d" and s[1:].isdigit() else "a"))
        self.before = np.array([[w(f"-{a}") + w(f"-0{a} {s}") for s in shapes] for a in shapes])
        self.after = np.array([[w(f"0{s}") + z(s) + w(f"+{a}") + w(f"0+{s} {a}") for a in shapes] for s in shapes])
        self.far = np.array([w(f"-2{s}") for s in shapes]), np.array([w(f"+2{s}") for s in shapes])
        self.tied = np.array([[w(f"t{k >> 1}{k & 1}") + w(f"t{k >> 1}{s}") for s in shapes] for k in range(4)])
        moves, size = field.moves, field.weights.shape[1]
        self.into = np.maximum(moves[:size].max(0) - moves[0, 0], moves[size] - moves[size, 0])[1:]
        self.out = max(0.0, (moves[1:size, 0] - moves[0, 0]).max())

    def _cut(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and shape code of each token."""
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(point) or point.max() >= 1 << 16:
            spans = tokens(text)
            edges = np.array(spans, np.int64).reshape(-1, 2)
            return edges[:, 0], edges[:, 1], np.array([self.shapes.get(shape(text[a:b]), self.other) for a, b in spans], np.int64)
        kind = self.tables["kind"][point]
        new = np.ones(len(kind) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _SINGLE)
        edges = np.flatnonzero(new)
        real = np.flatnonzero(kind[edges[:-1]] != _BLANK)
        first, end = edges[real], edges[real + 1]
        of = kind[first]
        codes = self.single[point[first]]
        digits = of == _DIGIT
        codes[digits] = self.runs[np.minimum((end - first)[digits], 20) - 1]
        at = np.flatnonzero(of == _LETTER)
        codes[at] = self._letters(point, first[at], end[at])
        return first, end, codes

    def _letters(self, point: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Codes of runs of letters: known words by their letters as one number, all others by case."""
        small, great = (np.concatenate([[0], np.cumsum(self.tables[t][point], dtype=np.int32)]) for t in ("lower", "upper"))
        begun = self.tables["upper"][point[first]]
        shouted = (small[first] == small[end]) & (great[first] < great[end])
        codes = np.where(shouted, self.shapes["X"], np.where(begun, self.shapes["Xx"], self.shapes["x"]))
        codes[~self.tables["alpha"][point[first]]] = self.other
        brief = np.flatnonzero(end - first <= _LONGEST_KEPT)
        start, size = first[brief], (end - first)[brief]
        word = np.zeros(len(brief), np.int64)
        for i in range(_LONGEST_KEPT):
            more = np.flatnonzero(size > i)
            word[more] |= self.tables["ascii"][point[start[more] + i]] << 8 * i
        place = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[place] == word
        codes[brief[known]] = self.word_codes[place[known]]
        return codes

    def _scores(self, codes: np.ndarray, tied: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of some tokens of a text; codes have two marks on either side."""
        c = [codes[at + k] for k in range(5)]
        return (self.before[c[1], c[2]] + self.after[c[2], c[3]] + self.far[0][c[0]] + self.far[1][c[4]]
                + self.tied[2 * tied[at] + tied[at + 1], c[2]])

    def decode(self, texts: list[str]) -> list[list[tuple[list[tuple[int, int]], np.ndarray]]]:
        """For each text the runs of tokens that need not be O, with their labels; all other tokens are O."""
        size = self.field.weights.shape[1]
        runs, scores, starts, ends = [], [], [], []
        for i, text in enumerate(texts):
            first, end, codes = self._cut(text)
            n = len(first)
            if not n:
                continue
            codes = np.concatenate([[0, 0], codes, [1, 1]])
            tied = np.zeros(n + 1, np.int64)
            tied[1:n] = first[1:] == end[:-1]
            gain = np.empty(n)
            for a in range(0, n, 16_384):
                s = self._scores(codes, tied, np.arange(a, min(n, a + 16_384)))
                gain[a:a + 16_384] = (s[:, 1:] + self.into).max(1) - s[:, 0]
            total = np.concatenate([[0.0], np.cumsum(gain)])
            # The most that a run of other labels through a token can gain over O.
            most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1]) + self.out
            live = np.flatnonzero(most >= -1e-6)
            if not len(live):
                continue
            breaks = np.flatnonzero(np.diff(live) > 1) + 1
            spans = list(zip(first[live].tolist(), end[live].tolist(), strict=True))
            score = self._scores(codes, tied, live)
            for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(live)], strict=True):
                runs.append((i, spans[a:b]))
                scores.append(score[a:b])
                starts.append(self.field.moves[0 if live[a] else size])
                ends.append(self.field.moves[:size, 0] if live[b - 1] < n - 1 else np.zeros(size))
        out: list[list[tuple[list[tuple[int, int]], np.ndarray]]] = [[] for _ in texts]
        for (i, spans), labels in zip(runs, self.field._paths(scores, starts, ends), strict=True):
            out[i].append((spans, labels))
        return out
