"""Op 10: SentencePiece encoding by streaming Viterbi, and decoding."""

from __future__ import annotations

import gc
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import bounded_batches, kept_in_workers, released

#: Where the public vocabulary lies; a parameter of every operator here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Encoded words that a worker remembers in each of two generations, and pairs of pieces of which it remembers whether they fit.
REMEMBERED, PAIRS = 100_000, 400_000
#: Words of a length or more from which on rows advance together, and characters of text that are looked through for new words at once.
TOGETHER, AHEAD = 8, 1 << 20
SPACE = "▁"


def load_pieces(path: str = MODEL) -> dict:
    """The model's pieces as plain lists: their text, score and kind, whether BPE or unigram. Its size is the vocabulary's."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    if not proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces or sentencepiece.__version__ is None:
        raise ValueError("a model with a dummy prefix that keeps white space is asked for")
    for p in proto.pieces:  # encode() takes it that all paths meet before a space and around a line feed
        word = p.piece.lstrip(SPACE)
        if p.type == kinds.NORMAL and (SPACE in word or (word and p.piece.startswith(SPACE * 2)) or ("\n" in word and p.piece != "\n")):
            raise ValueError(f"a piece crosses a space or a line feed: {p.piece!r}")
    return {
        "digest": hashlib.sha256(proto.SerializeToString()).hexdigest(),
        "bpe": proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE,
        "pieces": [(p.piece, p.score, {kinds.NORMAL: "n", kinds.BYTE: "b", kinds.UNKNOWN: "u"}.get(p.type, "c")) for p in proto.pieces],
    }


class Words(dict):
    """A memory of encoded words in two generations; the older one is dropped when the newer is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = array("i", self.make(word)).tobytes()
        if len(word) <= 64:
            self.keep(word, got)
        return got

    def keep(self, word: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids


#: Powers of an odd number: the weight of a character by its place from the end of a piece.
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _string_hash(text: str) -> int:
    codes = np.frombuffer(text[::-1].encode("utf-32-le"), np.uint32).astype(np.uint64)
    return int((codes * _POWERS[1 : len(codes) + 1]).sum(dtype=np.uint64))


class _Table:
    """64-bit keys to small numbers from 0 on, looked up many at a time in an open-addressing table that is at most half full."""

    def __init__(self):
        self.size, self.bits = 0, 14
        self.keys, self.held = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, held: np.ndarray) -> None:
        """Keys that are not there yet, each once."""
        self.size += len(keys)
        if 2 * self.size > 1 << self.bits:
            while 3 * self.size > 1 << self.bits:
                self.bits += 1
            full = self.held >= 0
            keys, held = np.concatenate([self.keys[full], keys]), np.concatenate([self.held[full], held])
            self.keys, self.held = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slots(keys)
        while len(keys):  # of several keys for a free slot one stays, the others try the next
            free = self.held[slot] < 0
            self.keys[slot[free]], self.held[slot[free]] = keys[free], held[free]
            left = self.keys[slot] != keys
            keys, held, slot = keys[left], held[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one that is not there."""
        slot = self._slots(keys)
        held = self.held[slot]
        wrong = np.flatnonzero((held >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            held[wrong] = self.held[slot[wrong]]
            wrong = wrong[(held[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return held.astype(np.int64)


def split_text(text: str) -> list[list[str]]:
    """Lines, each split at single spaces."""
    return [line.split(" ") for line in text.split("\n")]


class Encoder:
    """Words to ids. At every character boundary one survivor is kept: the piece that ends there on the best path.

    For a unigram model the survivor maximises the sum of scores. For a BPE model it is the only piece
    that the merges could leave there: a sequence of pieces is what BPE yields exactly when no two
    neighbours would have merged across their border before either was complete, so a piece survives if it fits
    the survivor at its start. In both cases the next pieces reach back at most max_len boundaries;
    once the survivors of those share a boundary on their backward paths, ids up to it are final. That is seen at once: every boundary counts the survivors
    that go back to it, one that no later piece can reach and none goes back to is given up, and a final boundary with one left commits it.
    stream() does so for one stretch, _learn() for many at a time by arrays.
    """

    def __init__(self, model: dict):
        self.bpe = model["bpe"]
        self.ids = {p: i for i, (p, _, kind) in enumerate(model["pieces"]) if kind == "n"}
        self.scores = [s for _, s, _ in model["pieces"]]
        self.bytes = [0] * 256
        self.unknown = next((i for i, (_, _, kind) in enumerate(model["pieces"]) if kind == "u"), 0)
        for i, (p, _, kind) in enumerate(model["pieces"]):
            if kind == "b":
                self.bytes[int(p[3:5], 16)] = i
        self.has_bytes = any(kind == "b" for _, _, kind in model["pieces"])
        self.single = {p for p in self.ids if len(p) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        if self.bpe:
            self._grow()
        self.texts = {i: p for p, i in self.ids.items()}
        self.max_len = max(map(len, self.ids), default=1)
        self.fits: dict[int, bool] = {}
        self.table: _Table | None = None
        self.tails = {p[k:]: -1 for p in self.ids for k in range(1, len(p))}  # what some piece ends with; a piece itself has its id
        self.tails |= self.ids
        self.first, self.spaced = Words(self.word, REMEMBERED // 4), Words(lambda w: self.word(SPACE + w), REMEMBERED)
        longest_space = max((len(p) for p in self.ids if set(p) == {SPACE}), default=1)
        self.longest_space = longest_space

    def _merge(self, piece: str) -> list[tuple[str, str]] | None:
        """The merges that build a piece, in order; None if merging does not end in the piece."""
        parts, done = list(piece), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if at < 0:
                return None
            done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return done

    def _grow(self) -> None:
        """The two halves of each piece that the last merge joins; what merging does not end in is no piece."""
        for p in list(self.ids):
            if len(p) > 1:
                done = self._merge(p)
                if done is None:
                    del self.ids[p]
                else:
                    self.halves[p] = done[-1]

    def _border(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at a piece's left (0) or right (1) border while it is built, with the score of the merge that swallows it."""
        at, swallowed, steps = piece, -np.inf, []
        while True:
            steps.append((at, swallowed))
            if at not in self.halves:
                return steps
            swallowed, at = self.scores[self.ids[at]], self.halves[at][side]

    def _fit(self, left: int, right: int) -> bool:
        ids, scores, begins = self.ids, self.scores, self._border(self.texts[right], 0)
        for x, x_gone in self._border(self.texts[left], 1):
            for y, y_gone in begins:
                j = ids.get(x + y)
                # merges go from high scores to low; at equal scores the one further left goes first
                if j is not None and scores[j] > x_gone and scores[j] >= y_gone:
                    return False
        return True

    def stream(self, text: str) -> list[int]:
        """Ids of a text of known characters, from a window of survivors that stays bounded."""
        most, bpe, scores, fits, tails = self.max_len, self.bpe, self.scores, self.fits, self.tails
        out: list[int] = []
        base = first = 0  # the boundary up to which ids are final, and the one of the lists' first entry
        piece, start, total, kids, kid_sum = [-1], [0], [0.0], [0], [0]
        for end in range(1, len(text) + 1):
            j, found = end, []
            while j > base:
                t = tails.get(text[j - 1 : end])
                if t is None:
                    break
                j -= 1
                if t >= 0:
                    found.append((t, j))
            got, at, best = -1, -1, -np.inf
            for t, j in reversed(found):
                before = piece[j - first]
                if bpe:
                    if before >= 0:
                        key = before << 20 | t
                        ok = fits.get(key)
                        if ok is None:
                            if len(fits) > PAIRS // 4:
                                fits.clear()
                            ok = fits[key] = self._fit(before, t)
                        if not ok:
                            continue
                    elif j:
                        continue
                    got, at = t, j
                    break
                if (j == base or before >= 0) and total[j - first] + scores[t] > best:
                    got, at, best = t, j, total[j - first] + scores[t]
            piece.append(got)
            start.append(at)
            total.append(best)
            kids.append(0)
            kid_sum.append(0)
            if got >= 0:
                kids[at - first] += 1
                kid_sum[at - first] += end
            gone = end - most  # no later piece begins there or before
            dead = gone
            while dead > base and piece[dead - first] >= 0 and not kids[dead - first]:
                up = start[dead - first]
                piece[dead - first] = -1
                kids[up - first] -= 1
                kid_sum[up - first] -= dead
                dead = up
            while base <= gone and kids[base - first] == 1:  # all paths meet in the one boundary that goes back to it
                base = kid_sum[base - first]
                out.append(piece[base - first])
            if base - first > 8 * most:
                cut = base - first
                for held in (piece, start, total, kids, kid_sum):
                    del held[:cut]
                first = base
        tail, at = [], len(text)
        while at > base:
            tail.append(piece[at - first])
            at = start[at - first]
        return out + tail[::-1]

    def learn(self, texts: list[list[list[str]]]) -> None:
        """Remembers the words of some texts, split into lines and words, many at a time: the survivors of all new words advance together."""
        if not self.bpe or SPACE not in self.single:
            return
        after, first = set(), set()
        for lines in texts:
            first.update([x[0] for x in lines[1:]])
            for k, parts in enumerate(lines):
                after.update(parts if k == 0 else parts[1:])
        for memory, new, mark in ((self.spaced, after, SPACE), (self.first, first, "")):
            new -= memory.keys()
            new -= memory.older.keys()
            fine = [w for w in new if 0 < len(w) <= 64 and SPACE not in w and self.single.issuperset(w)]
            fine.sort(key=len, reverse=True)
            for at in range(0, len(fine) - TOGETHER, 1 << 12):
                self._learn(memory, mark, fine[at : at + (1 << 12)])

    def _learn(self, memory: Words, mark: str, words: list[str]) -> None:
        """Remembers words of falling length: the survivors of all of them advance together, in a window of arrays over words, by the same steps as in stream()."""
        if self.table is None:
            keys = np.fromiter((_string_hash(p) for p in self.tails), np.uint64, len(self.tails))
            self.table, self.pairs = _Table(), _Table()
            self.table.add(keys, np.fromiter(self.tails.values(), np.int32, len(keys)) + np.int32(1))
        sizes = np.array([len(mark + w) for w in words])
        n, longest = len(words), int(sizes[0])
        codes = np.frombuffer("".join((mark + w).ljust(longest) for w in words).encode("utf-32-le"), np.uint32).reshape(n, longest).T.astype(np.uint64)
        window = 1 << min(longest, self.max_len + 1).bit_length()
        piece, start = np.full((n, window), -1, np.int64), np.zeros((n, window), np.int64)  # of boundary b in column b mod window
        kids, kid_sum = np.zeros((n, window), np.int32), np.zeros((n, window), np.int64)
        base, done = np.zeros(n, np.int64), np.zeros(n, np.int64)
        final: list[tuple[np.ndarray, np.ndarray]] = []  # rows and the ids that they commit, in order
        for end in range(1, longest + 1):
            n_live = int(np.searchsorted(-sizes, -end, "right"))
            if (end - base[:n_live]).max() >= window:  # paths that do not meet for long: the window grows
                old = np.arange(end - window, end)
                wider = []
                for held in (piece, start, kids, kid_sum):
                    grown = np.zeros((n, 2 * window), held.dtype)
                    grown[:, old % (2 * window)] = held[:, old % window]
                    wider.append(grown)
                (piece, start, kids, kid_sum), window = wider, 2 * window
            col = end % window
            piece[:n_live, col], kids[:n_live, col], kid_sum[:n_live, col] = -1, 0, 0
            live = np.arange(n_live)
            tail = np.zeros(len(live), np.uint64)
            found_row, found_piece, found_start = [], [], []
            for size in range(1, min(end, self.max_len) + 1):
                tail = tail + codes[end - size][live] * _POWERS[size]
                ids = self.table.find(tail)
                here = np.flatnonzero(ids > 0)
                found_row.append(live[here])
                found_piece.append(ids[here] - 1)
                found_start.append(np.full(len(here), end - size))
                longer = np.flatnonzero((ids >= 0) & (base[live] < end - size))
                live, tail = live[longer], tail[longer]
            row, own, at = (np.concatenate(x) for x in (found_row, found_piece, found_start))
            before = piece[row, at % window]
            ok = at == 0
            inside = np.flatnonzero((before >= 0) & ~ok)
            ok[inside] = self._fitting(before[inside], own[inside])
            row, own, at = row[ok], own[ok], at[ok]
            piece[row, col], start[row, col] = own, at  # of several the longest comes last and stays
            rows = np.flatnonzero(piece[:n_live, col] >= 0)
            up = start[rows, col] % window
            kids[rows, up] += 1
            kid_sum[rows, up] += end
            gone = end - self.max_len
            if gone < 0:
                continue
            dead = np.full(n_live, gone)
            rows = np.arange(n_live)
            while True:
                at = dead[rows] % window
                rows = rows[(dead[rows] > base[rows]) & (piece[rows, at] >= 0) & (kids[rows, at] == 0)]
                if not len(rows):
                    break
                at = dead[rows] % window
                up = start[rows, at]
                piece[rows, at] = -1
                kids[rows, up % window] -= 1
                kid_sum[rows, up % window] -= dead[rows]
                dead[rows] = up
            rows = np.flatnonzero(base[:n_live] <= gone)
            while True:
                rows = rows[(base[rows] <= gone) & (kids[rows, base[rows] % window] == 1)]
                if not len(rows):
                    break
                base[rows] = kid_sum[rows, base[rows] % window]
                final.append((rows, piece[rows, base[rows] % window]))
                done[rows] += 1
        committed = [b""] * n
        if final:
            rows, ids = (np.concatenate(x) for x in zip(*final, strict=True))
            order = np.argsort(rows, kind="stable")
            raw = ids[order].astype(np.int32).tobytes()
            upto = np.r_[0, np.cumsum(done)].tolist()
            committed = [raw[4 * a : 4 * b] for a, b in zip(upto, upto[1:], strict=False)]
        widest = int((sizes - base).max())
        ids, position, step = np.zeros((n, widest), np.int32), sizes.copy(), np.zeros(n, np.int64)
        while True:  # what is left of each word in the window
            row = np.flatnonzero(position > base)
            if not len(row):
                break
            at = position[row] % window
            ids[row, widest - 1 - step[row]] = piece[row, at]
            step[row] += 1
            position[row] = start[row, at]
        raw = ids.tobytes()
        for i, (word, count) in enumerate(zip(words, step.tolist(), strict=True)):
            memory.keep(word, committed[i] + raw[4 * ((i + 1) * widest - count) : 4 * (i + 1) * widest])

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces stand next to each other, from a table that grows by the pairs it has not yet seen."""
        pair = (left << 20 | right).astype(np.uint64)
        got = self.pairs.find(pair)
        if (got < 0).any():
            if self.pairs.size > PAIRS:
                self.pairs = _Table()
                got[:] = -1
            new = np.unique(pair[got < 0])
            self.pairs.add(new, np.array([self._fit(k >> 20, k & 0xFFFFF) for k in new.tolist()], np.int32))
            got = self.pairs.find(pair)
        return got == 1

    def spell(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.has_bytes else [self.unknown]

    def word(self, text: str) -> list[int]:
        """Ids of a stretch without spaces, the first character possibly the mark of one before it."""
        out: list[int] = []
        begin = 0
        for i in range(1 if text[:1] == SPACE else 0, len(text)):
            if text[i] not in self.single or text[i] == SPACE:  # a mark inside is the text's own, not a space
                if begin < i:
                    out += self.stream(text[begin:i])
                out += self.spell(text[i])
                begin = i + 1
        if begin < len(text):
            out += self.stream(text[begin:])
        return out

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of n spaces that no word takes part in."""
        if not self.bpe:
            return self.stream(SPACE * n)
        whole, rest = divmod(n, self.longest_space)
        return [self.ids[SPACE * self.longest_space]] * whole + ([self.ids[SPACE * rest]] if rest else [])

    def encode(self, text: str, lines: list[list[str]] | None = None) -> np.ndarray:
        """Ids of a whole text (split_text(text), if that is at hand); an empty text has none. No piece crosses a space, so all paths meet before each one, and words are encoded and remembered one by one."""
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        newline = array("i", [self.ids["\n"]] if "\n" in self.single else self.spell("\n")).tobytes()
        mark = SPACE in text
        for k, parts in enumerate(split_text(text) if lines is None else lines):
            if k:
                out.append(newline)
            else:
                parts = ["", *parts]  # the dummy prefix is a space before the text
            if mark or "" in parts[1:]:
                own: list[int] = []
                self._spaced(own, parts)
                out.append(array("i", own).tobytes())
            else:
                if parts[0]:
                    out.append(self.first[parts[0]])
                out += map(self.spaced.__getitem__, parts[1:])
        return np.frombuffer(b"".join(out), np.int32)

    def _spaced(self, out: list[int], parts: list[str]) -> None:
        """A line with runs of spaces, or with the mark itself in it."""
        if parts[0]:
            out += self._own(parts[0], False)
        run = 0
        for part in parts[1:]:
            run += 1
            if part:
                word = self._own(part, True)
                if run > 1 and word and word[0] == self.ids[SPACE]:  # the word leaves the last space to the run
                    out += self.spaces(run)
                    out += word[1:]
                else:
                    if run > 1:
                        out += self.spaces(run - 1)
                    out += word
                run = 0
        if run:
            out += self.spaces(run)

    def _own(self, part: str, spaced: bool) -> list[int]:
        """A word in which the mark stands for itself; it is spelt in bytes so that decoding gives it back."""
        out: list[int] = []
        for i, bit in enumerate(part.split(SPACE)):
            if i:
                out += self.spell(SPACE)
            if spaced and i == 0:
                out += array("i", self.spaced[bit])
            elif bit:
                out += array("i", self.first[bit])
        return out


class Decoder:
    def __init__(self, model: dict):
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == "b" else p.replace(SPACE, " ").encode() if kind == "n" else b"" for p, _, kind in model["pieces"]]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, without the space before the text."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(self.begins[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return out[1:] if len(out) and out[0] == 32 else out

    def gives(self, ids: np.ndarray, text: str) -> bool:
        """Whether ids decode to the text."""
        return self.spelt(ids).tobytes() == text.encode() or self.decode(ids.tolist()) == text

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _some(column: pa.Array):
    """Lists of some rows of a column, of about AHEAD characters."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)))
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + AHEAD, "right")))
        yield column.slice(row, end - row).to_pylist()
        row = end


_made: dict[type, tuple] = {}


def _forget() -> None:
    if _made:
        gc.unfreeze()
        _made.clear()
        gc.collect()


kept_in_workers["pieces"] = _forget


def _worker(kind, model) -> object:
    """The encoder or decoder of the last model in each Python worker, so that words stay remembered between tasks."""
    if kind not in _made or _made[kind][0] != model.value["digest"]:
        gc.unfreeze()
        _made[kind] = (model.value["digest"], kind(model.value))
        gc.freeze()  # the vocabulary stays; collecting garbage need not visit it
    return _made[kind][1]


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL, check: bool = False) -> DataFrame:
    """(key, n_tokens, ids) and with check also round_trip: whether decoding gives the text back.

    Whole texts are encoded. A null text gives null ids, n_tokens and round_trip; an empty one has no
    ids. A character outside the vocabulary is spelt in bytes. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(load_pieces(path))
    kind = docs.schema[key].dataType

    def run(batches):
        coder, back = _worker(Encoder, model), _worker(Decoder, model)
        for batch in batches:
            texts, start = batch.column(1), 0
            for part in _some(texts):
                lines = [split_text(t) if t else [] for t in part]
                coder.learn([x for x in lines if x])
                found = [coder.encode(t or "", x) for t, x in zip(part, lines, strict=True)]
                ends = np.r_[0, np.cumsum([len(ids) for ids in found])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)), mask=pa.array([t is None for t in part]))
                same = [pa.array([None if t is None else back.gives(ids, t) for ids, t in zip(found, part, strict=True)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), lists, *same], ["k", "ids"] + (["round_trip"] if check else []))
                start += len(part)

    schema = f"k {kind.simpleString()}, ids array<int>" + (", round_trip boolean" if check else "")
    out = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(released(run, "pieces"), schema)
    return out.select(F.col("k").alias(key), F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), "ids", *(["round_trip"] if check else []))


def decode(coded: DataFrame, ids: str = "ids", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """(key, text) of a table of ids; null ids give a null text."""
    model = coded.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches):
        back = _worker(Decoder, model)
        for batch in batches:
            texts = [None if x is None else back.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return coded.select(key, ids).mapInArrow(released(run, "pieces"), f"k {coded.schema[key].dataType.simpleString()}, text string").withColumnRenamed("k", key)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and whether they decode to the text; see encode for nulls, empty and long texts and repeated rows."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: (doc_id, n_tokens, ids) of every text; null texts have null ids, empty ones none, repeated rows repeat, an empty table gives no rows."""
    return encode(docs)
