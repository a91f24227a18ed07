"""A linear-chain conditional random field over the shapes of words, with Viterbi decoding of many lines at once.

Words are maximal runs without white space; a line is a chain. A word is described by its letters, by the shape of its
characters (merged runs and place by place), by its digits and punctuation, by a check of its digits, and by the same of
its neighbours. Descriptions are arrays over all characters or words of a batch; the recursions run along the positions
of all lines together.
"""

from __future__ import annotations

import numpy as np

SPACE, LOWER, UPPER, DIGIT = 0, 1, 2, 3
#: Classes of the first 128 code points: each sign is a class of its own; others are letters or blanks.
CLASS = np.array([SPACE if c in b" \t\n\v\f\r\x1c\x1d\x1e\x1f" else DIGIT if 48 <= c <= 57 else UPPER if 65 <= c <= 90
                  else LOWER if 97 <= c <= 122 else c + 4 for c in range(128)] + [LOWER], np.uint8)
WIDE_BLANKS = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
SIGNS = "@+(.-:["
MARK = np.zeros(256, np.uint8)
for _bit, _sign in enumerate(SIGNS):
    MARK[CLASS[ord(_sign)]] = 1 << _bit
MARK[[CLASS[ord(")")]]] |= 1 << SIGNS.index("(")
MARK[[CLASS[ord(s)] for s in "]{}<>"]] |= 1 << SIGNS.index("[")
#: Signs that may end a sentence: one at a word's end is no part of its shape.
ENDS = CLASS[[ord(c) for c in ".,;:!?"]]
DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 7, 9, 13, 20])
MIX = np.random.default_rng(13).integers(0, 1 << 63, (3, 512, 48), dtype=np.uint64)
#: What describes a word, and at which neighbours (0: the word itself).
PLACES = {"letters": (-2, -1, 0, 1, 2), "merged": (-1, 0, 1), "shape": (0,), "digits": (-2, -1, 0, 1, 2), "marks": (0,),
          "check": (-1, 0, 1)}
LEARNED = ("letters", "merged", "shape")
SIZES = {"digits": len(DIGIT_STEPS) + 1, "marks": 1 << len(SIGNS), "check": 6}


def luhn(digits: str) -> bool:
    twice = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in twice)) % 10 == 0


class Words:
    """Words of some texts: text number, first and last+1 code point in the text, line, and their descriptions."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        text_start = np.cumsum(sizes) - sizes
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = CLASS[np.minimum(code, 128)]
        if not joined.isascii():
            wide = np.flatnonzero(code > 127)
            kind[wide[np.isin(code[wide], WIDE_BLANKS)]] = SPACE
        at = np.flatnonzero(kind != SPACE)
        kind = kind[at]
        opens = np.r_[True, at[1:] != at[:-1] + 1] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(opens)
        word = np.cumsum(opens) - 1
        length = np.diff(np.r_[first, len(at)])
        start = at[first]
        self.text = np.searchsorted(text_start, start, side="right") - 1
        self.start = start - text_start[self.text]
        self.end = self.start + length
        breaks = np.flatnonzero(code == 10)
        line = np.searchsorted(breaks, start)
        edge = np.flatnonzero(np.r_[True, line[1:] != line[:-1], True]) if len(line) else np.zeros(1, np.int64)
        self.first, self.lengths = edge[:-1], np.diff(edge)
        place = np.arange(len(at)) - first[word]
        runs = opens | np.r_[True, kind[1:] != kind[:-1]] if len(at) else opens
        run = np.cumsum(runs)
        letter = (kind == LOWER) | (kind == UPPER)
        nth = np.cumsum(letter)
        digit = kind == DIGIT
        if not len(first):
            self.values = {c: np.zeros(0, np.uint64 if c in LEARNED else np.int64) for c in PLACES}
            return
        sums = lambda x: np.add.reduceat(x, first)
        before = nth[first] - letter[first]
        which = np.flatnonzero(letter)
        folded = code[at[which]]
        folded = np.where(kind[which] == UPPER, folded + 32, folded) % 512
        spelt = np.zeros(len(at), np.uint64)
        spelt[which] = MIX[0][folded, np.minimum(nth[which] - before[word[which]] - 1, 47)]
        closing = (first + length - 1)[(length > 1) & np.isin(kind[first + length - 1], ENDS)]
        whole = MIX[2][kind, np.minimum(place, 47)]
        whole[closing] = 0
        runs[closing] = False
        ones = np.flatnonzero(runs)
        merged = np.zeros(len(at), np.uint64)
        merged[ones] = MIX[1][kind[ones], np.minimum(run[ones] - run[first][word[ones]], 47)]
        self.values = {
            "letters": sums(spelt), "merged": sums(merged), "shape": sums(whole),
            "digits": np.searchsorted(DIGIT_STEPS, count := sums(digit.astype(np.int64)), side="right"),
            "marks": np.bitwise_or.reduceat(MARK[kind], first).astype(np.int64),
            "check": np.zeros(len(first), np.int64)}
        dots = sums((kind == CLASS[ord(".")]).astype(np.int64))
        for i in np.flatnonzero((count >= 13) & (count <= 19) | (dots == 3) & (count >= 4)).tolist():
            held = joined[start[i]:start[i] + length[i]]
            self.values["check"][i] = _check(held, int(count[i]))


def _check(word: str, digits: int) -> int:
    """1 or 2: 13 to 19 digits that pass or fail the card sum; 3 or 4: four dotted numbers up to 255, or beyond."""
    parts = word.strip("\"'()[]{}<>,;:.!?*#$%|").split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        return 3 if all(len(p) < 6 and int(p) <= 255 for p in parts) else 4
    if digits >= 13 and not any(c.isalpha() for c in word):
        return 1 if luhn("".join(c for c in word if "0" <= c <= "9")) else 2
    return 0


class ShapeChain:
    """Weights of `labels` labels: of descriptions, of transitions and of a line's first word."""

    def __init__(self, labels: int):
        self.labels = labels
        self.known: dict[str, np.ndarray] = {}

    def learn_values(self, words: Words, seen: int) -> None:
        """Values of letters and shapes that come `seen` times or more; all others are one unknown value."""
        for name in LEARNED:
            value, n = np.unique(words.values[name], return_counts=True)
            self.known[name] = value[n >= seen]
        self.base, total = {}, 0
        for name, places in PLACES.items():
            width = (len(self.known[name]) + 1 if name in LEARNED else SIZES[name]) + 1  # the last: no such neighbour
            for p in places:
                self.base[name, p] = (total, width)
                total += width
        self.emit = np.zeros((total, self.labels))
        self.move = np.zeros((self.labels, self.labels))
        self.open = np.zeros(self.labels)

    def features(self, words: Words) -> list[np.ndarray]:
        """For each description and neighbour the row of `emit` of every word."""
        inside = np.repeat(np.arange(len(words.first)), words.lengths)
        n = len(inside)
        out = []
        for name, places in PLACES.items():
            value = words.values[name]
            if name in LEARNED:
                known = self.known[name]
                i = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
                value = np.where(known[i] == value, i, len(known)) if len(known) else np.zeros(n, np.int64)
            for p in places:
                first, width = self.base[name, p]
                at = np.full(n, width - 1)
                if p == 0:
                    at = value
                elif n > abs(p):
                    to, of = (slice(None, -p), slice(p, None)) if p > 0 else (slice(-p, None), slice(None, p))
                    at[to] = np.where(inside[to] == inside[of], value[of], width - 1)
                out.append(first + at)
        return out

    def scores(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.start), self.labels))
        for at in self.features(words):
            out += self.emit[at]
        return out

    @staticmethod
    def layout(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rows of the lines from long to short; how many lines are longer than t."""
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        return first[order], np.searchsorted(-lengths[order], -np.arange(longest), side="left")

    def decode(self, words: Words) -> np.ndarray:
        """The best labels of every line, by Viterbi."""
        score = self.scores(words)
        n = len(score)
        back = np.zeros((n, self.labels), np.int8)
        first, alive = self.layout(words.first, words.lengths)
        if not n:
            return np.zeros(0, np.int64)
        score[first] += self.open
        for t in range(1, len(alive)):
            rows = first[:alive[t]] + t
            ways = score[rows - 1][:, :, None] + self.move
            back[rows] = ways.argmax(axis=1)
            score[rows] += ways.max(axis=1)
        label = np.zeros(n, np.int64)
        last = words.first + words.lengths - 1
        label[last] = score[last].argmax(axis=1)
        for t in range(len(alive) - 1, 0, -1):
            rows = first[:alive[t]] + t
            label[rows - 1] = back[rows, label[rows]]
        return label

    def fit(self, words: Words, labels: np.ndarray, seen: int = 2, l2: float = 0.5, rounds: int = 80,
            rate: float = 0.1) -> ShapeChain:
        """Penalised maximum likelihood by Adam steps; `labels` has one label per word."""
        self.learn_values(words, seen)
        n, k = len(labels), self.labels
        if not n:
            return self
        rows = np.stack(self.features(words), axis=1)
        width = rows.shape[1]
        flat = rows.ravel()
        want = np.eye(k)[labels]
        first, alive = self.layout(words.first, words.lengths)
        inner = np.ones(n, bool)
        inner[words.first] = False
        at = np.flatnonzero(inner)
        moved = np.zeros((k, k))
        np.add.at(moved, (labels[at - 1], labels[at]), 1)
        weights = np.zeros(self.emit.size + k * k + k)
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        cut = self.emit.size
        for step in range(1, rounds + 1):
            self.emit = weights[:cut].reshape(-1, k)
            self.move, self.open = weights[cut:cut + k * k].reshape(k, k), weights[cut + k * k:]
            score = self.emit[rows].sum(axis=1)
            p, moves = self._expected(score, first, alive, words)
            rest = want - p
            emit = np.stack([np.bincount(flat, np.repeat(rest[:, y], width), len(self.emit)) for y in range(k)], axis=1)
            grad = np.r_[emit.ravel(), (moved - moves).ravel(), rest[words.first].sum(axis=0)]
            grad = (grad - l2 * weights) / len(words.first)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
            weights = weights + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self.emit = weights[:cut].reshape(-1, k)
        self.move, self.open = weights[cut:cut + k * k].reshape(k, k), weights[cut + k * k:]
        return self

    def _expected(self, score: np.ndarray, first: np.ndarray, alive: np.ndarray, words: Words):
        """Marginals of every word and the expected transitions of all lines together, by forward and backward sums."""
        forward, backward = score.copy(), np.zeros_like(score)
        forward[first] += self.open
        for t in range(1, len(alive)):
            rows = first[:alive[t]] + t
            ways = forward[rows - 1][:, :, None] + self.move
            top = ways.max(axis=1)
            forward[rows] += top + np.log(np.exp(ways - top[:, None, :]).sum(axis=1))
        last = first + np.sort(words.lengths)[::-1] - 1
        z = np.logaddexp.reduce(forward[last], axis=1)
        moves = np.zeros_like(self.move)
        for t in range(len(alive) - 1, 0, -1):
            rows = first[:alive[t]] + t
            after = (score[rows] + backward[rows])[:, None, :] + self.move
            top = after.max(axis=2)
            backward[rows - 1] = top + np.log(np.exp(after - top[:, :, None]).sum(axis=2))
            moves += np.exp(forward[rows - 1][:, :, None] + after - z[:len(rows), None, None]).sum(axis=0)
        log_p = forward + backward
        log_p -= log_p.max(axis=1, keepdims=True)
        p = np.exp(log_p)
        return p / p.sum(axis=1, keepdims=True), moves
