"""SentencePiece encoding and decoding by a Viterbi pass over the trie of a batch's distinct words.

A text becomes marked words (a run of marks and what follows up to the next mark). The distinct
words of a batch are sorted, so that neighbours share prefixes, and walked depth-first: the forward
state of a prefix is worked out once for all words that begin with it.

For a unigram model the state is the best score. For a merge (BPE) model a step is allowed only
if the model's merges would leave the two pieces side by side; exactly one path then remains for
every prefix, and it is what the merges give.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Bytes of one generation of words with their results, and pairs, that a Python worker keeps.
KEPT_BYTES = 32 << 20
KEPT_PAIRS = 300_000
#: Longer words hardly come again; they are worked out each time.
KEPT_LETTERS = 64
#: Bytes of text whose words make one trie.
TRIE_BYTES = 3 << 20


class Vocabulary:
    """Pieces of a model file with their scores; how texts are cut into pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.unknown = model.unk_id()
        self.bytes = {}
        self.ids: dict[str, int] = {}
        self.scores = [model.get_score(number) for number in range(count)]
        self.spelled: list[bytes] = []
        for number in range(count):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                self.bytes[int(piece[1:-1], 16)] = number
                self.spelled.append(bytes([int(piece[1:-1], 16)]))
                continue
            plain = not (model.is_control(number) or model.is_unused(number) or model.is_unknown(number))
            self.spelled.append(piece.replace(MARK, " ").encode() if plain else b"")
            if plain:
                self.ids[piece] = number
        self.longest = max(map(len, self.ids), default=1)
        # Every ending of a piece: its number if it is a piece itself, else -1. A look back from a
        # letter stops at the first run of letters that no piece ends with.
        self.endings = {piece[at:]: -1 for piece in self.ids for at in range(len(piece))}
        self.endings |= self.ids
        self.pieces = {number: piece for piece, number in self.ids.items()}
        # Merges are tried by score, best first; the model kind shows in the library's own answer.
        self.merges = _is_merge_model(model, self)
        order = sorted(self.ids.values(), key=lambda number: -self.scores[number])
        self.rank = {number: place for place, number in enumerate(order)}
        # Results of merges whose score another one shares: their order also depends on where they
        # stand. A letter is no result of a merge.
        merged = [number for number in order if len(self.pieces[number]) > 1]
        best = [self.scores[number] for number in merged]
        ties = {score for score, after in zip(best, best[1:], strict=False) if score == after}
        tied = [re.escape(self.pieces[number]) for number in merged if self.scores[number] in ties]
        self.tied = re.compile("|".join(tied)) if tied else None
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merge(self, word: str) -> list[str]:
        """Merge neighbours, the best-scored result first and leftmost among equals, to the end."""
        return self._merge(word)[0]

    def _merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that are left, and the two that the last merge joined."""
        count = len(word)
        parts: list[str | None] = list(word)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap: list[tuple[float, int, str, str]] = []
        joined = None

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right < count:
                number = self.ids.get(parts[left] + parts[right])
                if number is not None:
                    heapq.heappush(heap, (-self.scores[number], left, parts[left], parts[right]))

        for at in range(count - 1):
            offer(at)
        while heap:
            _, left, one, other = heapq.heappop(heap)
            right = after[left]
            if parts[left] != one or right >= count or parts[right] != other:
                continue
            joined = one, other
            parts[left], parts[right] = one + other, None
            after[left] = after[right]
            if after[left] < count:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [part for part in parts if part is not None], joined

    def halves(self, number: int) -> tuple[int, int] | None:
        """The last merge that makes a piece; (number, number) for a letter, None if merges never do."""
        if number not in self._halves:
            piece = self.pieces[number]
            left, joined = self._merge(piece)
            if len(piece) == 1:
                self._halves[number] = number, number
            else:
                self._halves[number] = tuple(self.ids[part] for part in joined) if len(left) == 1 else None
        return self._halves[number]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' letters ends with just these two pieces.

        Undo the merges of both pieces from the last to the first; at every stage the pair that
        meets in the middle must not have been merged before the later of the two was made.
        """
        limit = len(self.rank)
        rank = self.rank
        while True:
            joined = self.ids.get(self.pieces[left] + self.pieces[right])
            if joined is not None and rank[joined] < limit:
                return False
            open_left, open_right = len(self.pieces[left]) > 1, len(self.pieces[right]) > 1
            if not (open_left or open_right):
                return True
            if open_left and (not open_right or rank[left] > rank[right]):
                limit = rank[left]
                left = self.halves(left)[1]
            else:
                limit = rank[right] + 1
                right = self.halves(right)[0]


def _is_merge_model(model, vocabulary: Vocabulary) -> bool:
    """A merge model gives its pieces scores 0, -1, -2, ...: whole numbers, unlike log likelihoods."""
    plain = [score for score in vocabulary.scores if -1e8 < score < 0]
    return bool(plain) and all(score == int(score) for score in plain)


class Encoder:
    """Pieces of marked words; keeps what it has worked out, within bounds."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # Words of late batches, and of those before: what comes up again and again stays. Piece
        # numbers of a word are packed, four bytes each.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        self.verdicts: dict[int, bool] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece numbers of every text; null for a null text."""
        split = [None if text is None else _WORD.findall(_marked(text)) for text in texts]
        wanted = set(chain.from_iterable(words for words in split if words))
        table = {word: self.young[word] for word in wanted if word in self.young}
        fresh = {word: self.old[word] for word in wanted if word not in table and word in self.old}
        unseen = sorted(word for word in wanted if word not in table and word not in fresh)
        fresh.update((word, numbers.tobytes()) for word, numbers in self.walk(unseen))
        self._keep(fresh)
        table |= fresh
        out = []
        for words in split:
            if words is None:
                out.append(None)
            else:
                out.append(np.frombuffer(b"".join(map(table.__getitem__, words)), np.int32))
        return out

    def _keep(self, fresh: dict[str, bytes]) -> None:
        for word, numbers in fresh.items():
            if len(word) > KEPT_LETTERS:
                continue
            # Word, numbers and their place in the table.
            size = sys.getsizeof(word) + sys.getsizeof(numbers) + 100
            if self.young_bytes + size > KEPT_BYTES:
                self.young, self.old, self.young_bytes = {}, self.young, 0
            self.young[word] = numbers
            self.young_bytes += size

    def walk(self, words: list[str]) -> Iterator[tuple[str, array]]:
        """Depth-first over the trie of sorted words: states of a shared prefix are kept.

        States are arrays, sixteen bytes a letter, so that a long text without spaces fits.
        """
        last, start, score = array("i", [-1]), array("i", [0]), array("d", [0.0])
        before = ""
        step = self._merge_step if self.vocabulary.merges else self._score_step
        tied = self.vocabulary.tied if self.vocabulary.merges else None
        for word in words:
            if tied is not None and tied.search(word):
                yield word, self._merged(word)
                continue
            shared = 0
            for one, other in zip(before, word, strict=False):
                if one != other:
                    break
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                step(word, end, last, start, score)
            before = word
            yield word, self._path(word, last, start)

    def _merged(self, word: str) -> array:
        numbers = array("i")
        for piece in self.vocabulary.merge(word):
            numbers.extend(self._spell(piece))
        return numbers

    def _spell(self, piece: str) -> list[int]:
        """A piece's number; of a letter that is none, the pieces of its bytes or the unknown piece."""
        number = self.vocabulary.ids.get(piece)
        if number is not None:
            return [number]
        pieces = self.vocabulary.bytes
        return [pieces[byte] for byte in piece.encode()] if pieces else [self.vocabulary.unknown]

    def _path(self, word: str, last: array, start: array) -> array:
        end, numbers = len(word), array("i")
        while end:
            if last[end] < 0:
                numbers.extend(reversed(self._spell(word[end - 1])))
            else:
                numbers.append(last[end])
            end = start[end]
        numbers.reverse()
        return numbers

    def _score_step(self, word: str, end: int, last: array, start: array, score: array) -> None:
        vocabulary = self.vocabulary
        best, piece, begin = None, -1, end - 1
        for at in range(max(0, end - vocabulary.longest), end):
            number = vocabulary.ids.get(word[at:end])
            if number is not None:
                total = score[at] + vocabulary.scores[number]
                if best is None or total > best:
                    best, piece, begin = total, number, at
        if best is None:
            best = score[end - 1] + min(vocabulary.scores) - 10
        last.append(piece)
        start.append(begin)
        score.append(best)

    def _merge_step(self, word: str, end: int, last: array, start: array, score: array) -> None:
        vocabulary = self.vocabulary
        endings, verdicts = vocabulary.endings, self.verdicts
        for at in range(end - 1, max(-1, end - 1 - vocabulary.longest), -1):
            number = endings.get(word[at:end])
            if number is None:
                break
            if number < 0:
                continue
            left = last[at]
            if left < 0:
                # The word's start, or a letter that no merge touches.
                if vocabulary.halves(number) is None:
                    continue
            else:
                pair = left << 20 | number
                fits = verdicts.get(pair)
                if fits is None:
                    if len(verdicts) >= KEPT_PAIRS:
                        verdicts.clear()
                    fits = vocabulary.halves(number) is not None and vocabulary.side_by_side(left, number)
                    verdicts[pair] = fits
                if not fits:
                    continue
            last.append(number)
            start.append(at)
            score.append(score[at] + vocabulary.scores[number])
            return
        last.append(-1)
        start.append(end - 1)
        score.append(score[end - 1])


def _marked(text: str) -> str:
    """One mark before the text and one for every space; an empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def decode(numbers: np.ndarray, spelled: list[bytes]) -> str:
    """The text of piece numbers, without the mark that encoding put before it."""
    whole = b"".join([spelled[number] for number in numbers.tolist()])
    return whole[1:].decode("utf-8", "replace") if whole[:1] == b" " else whole.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def _encode(path: str, check: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        spelled = encoder.vocabulary.spelled
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(1).to_pylist()
                found = encoder.encode(texts)
                lengths = np.array([0 if one is None else len(one) for one in found], np.int64)
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum(lengths, out=offsets[1:])
                values = np.concatenate([np.zeros(0, np.int32), *[one for one in found if one is not None]])
                missing = pa.array([one is None for one in found], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=missing)
                columns, names = [part.column(0), lists], ["_row", "ids"]
                if check:
                    back = [None if one is None else decode(one, spelled) for one in found]
                    same = [None if a is None else a.replace(MARK, " ") == b for a, b in zip(texts, back, strict=True)]
                    columns += [pa.array(back, pa.string()), pa.array(same, pa.bool_())]
                    names += ["decoded", "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return emit


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut so that each part has about ``TRIE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // TRIE_BYTES)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def _decode(path: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _encoder(path).vocabulary.spelled
        for batch in batches:
            texts = [None if ids is None else decode(np.array(ids, np.int64), spelled) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "text"])

    return emit


def _carried(docs: DataFrame, column: str, carry: list[str] | None) -> DataFrame:
    names = [name for name in docs.columns if name != column] if carry is None else carry
    row = F.struct(*[F.col(f"`{name}`") for name in names])
    return docs.select(row.alias("_row"), F.col(f"`{column}`").alias("_value"))


def encode_texts(
    docs: DataFrame, text_col: str = "text", model: str = MODEL, carry: list[str] | None = None, check: bool = True
) -> DataFrame:
    """Per row: ``_row`` (the carried columns), ids, and with ``check`` also decoded, round_trip.

    ``ids`` are the piece numbers of the whole text, null for a null text and empty for an empty
    one. ``round_trip`` compares the decoded text with the input, where the mark character itself
    reads as a space, as in the format. ``model`` is a file that every executor can read.
    """
    rows = _carried(docs, text_col, carry)
    more = ", decoded string, round_trip boolean" if check else ""
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, ids array<int>{more}"
    return rows.mapInArrow(_encode(model, check), schema)


def decode_ids(docs: DataFrame, ids_col: str = "ids", model: str = MODEL, carry: list[str] | None = None) -> DataFrame:
    """Per row: ``_row`` (the carried columns) and the text of its piece numbers; null for null."""
    rows = _carried(docs, ids_col, carry)
    return rows.mapInArrow(_decode(model), f"_row {rows.schema['_row'].dataType.simpleString()}, text string")
