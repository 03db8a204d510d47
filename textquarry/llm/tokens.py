"""Whole-text tokenisation with a public vocabulary, each distinct word encoded once a batch.

Both vocabularies cut a text into words before any merge, and a space that
follows a non-space and precedes a non-space always starts a new word. A batch is
therefore cut at spaces by Arrow, its distinct pieces are cut at marks and line
ends, the parts that are not remembered are encoded by the tokenizers library,
and the ids are gathered back by Arrow. Texts in which
that does not hold (runs of white space, in the byte vocabulary) are encoded whole.
"""

import os
from array import array
from codecs import charmap_decode
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textquarry.llm.memory import give_back

#: White space of any kind before a space that is followed by white space or the end: such a run is one token.
RUN = r"[\t-\r \x1c-\x1f\x{85}\p{Z}] (?:[\t-\r \x1c-\x1f\x{85}\p{Z}]|$)"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


#: Letters of Latin-1, and marks that never join a letter before them (an apostrophe may), as members of a set in a pattern.
LETTERS, MARKS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r'.,;:!?*&%$#)(\-"'

#: What stands between the parts of a word; words that hold it themselves, or a line end that is not between a letter or mark and a letter, stay whole.
CUT = "\0"
UNCUT = rf"\x00|(?:^|[^{LETTERS}{MARKS}])\n|\n(?:[^{LETTERS}]|$)"

#: Words and their ids.
HELD = pa.schema([("word", pa.large_string()), ("ids", pa.large_binary())])


def binaries(data: np.ndarray | array, ends: np.ndarray | array) -> pa.LargeBinaryArray:
    """Ids in a row as one value for each word; ends: where each word's ids end."""
    offsets = np.concatenate([[0], np.asarray(ends, np.int64)]) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def numbers(ids: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all values in a row, and where each value's ids begin (one more entry than values)."""
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
    return np.frombuffer(data, np.uint32, int(at[-1])) if at[-1] else np.zeros(0, np.uint32), at


class Encoder:
    """Encodes Arrow string arrays to ids. ``keeps_spaces``: spaces belong to the words they precede.

    The strings of special tokens in a text are ordinary text, as the vocabularies' own description sets it
    (``encode_special_tokens``); with ``special_ids`` they get the special ids instead.
    Twice ``remember`` words are kept: in ``old`` those met in several slices, ``remember`` at most and those met last,
    and in ``young`` the newest of the others. They lie in Arrow arrays and are looked up a slice at a time.
    """

    def __init__(self, path: str, keeps_spaces: bool, remember: int = 250_000, special_ids: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special_ids
        #: Texts with one of these are encoded whole: a special string may hold white space, and the case of its letters counts.
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()] if special_ids else []
        self.model = self.tok.model
        self.keeps_spaces, self.remember = keeps_spaces, remember
        self.forget()
        letters = byte_letters()
        #: The byte-level alphabet by byte, to spell UTF-8 with.
        self.spell = "".join(letters[b] for b in range(256))
        #: A line end between words is a word where spaces are kept, and nothing elsewhere.
        self.line = f"{CUT}\n{CUT}" if keeps_spaces else CUT

    def forget(self) -> None:
        self.young = self.old = pa.RecordBatch.from_pylist([], HELD)

    def _words(self, words: pa.LargeStringArray) -> tuple[pa.RecordBatch, np.ndarray]:
        """Each word (with its space, if it has one) with its ids, and the places these words had.

        A word of Latin-1 letters passes the normaliser and the word pattern whole and unchanged (but for case),
        so it goes to the vocabulary's merges at once.
        """
        plain = np.asarray(pc.match_substring_regex(words, f"^{' ?' * self.keeps_spaces}[{LETTERS}]+$"))
        order = np.argsort(~plain, kind="stable")
        words = words.take(pa.array(order))
        texts = words.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        few = int(plain.sum())
        ids, ends, tokenize = array("I"), array("q"), self.model.tokenize
        for at in range(0, few, 4096):
            part = "\n".join(texts[at : min(few, at + 4096)])  # spelled at once; no such word holds a line end
            for spelled in charmap_decode((part if self.keeps_spaces else part.lower()).encode(), "strict", self.spell)[0].split(self.spell[10]):
                ids.extend([t.id for t in tokenize(spelled)])
                ends.append(len(ids))
        for at in range(few, len(texts), 4096):
            for e in self.tok.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
                ids.extend(e.ids)
                ends.append(len(ids))
        return pa.RecordBatch.from_arrays([words, binaries(ids, ends)], schema=HELD), order

    def _parts(self, words: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray, np.ndarray]:
        """The words in another order, the parts of all words in that order, and how many each has.

        Marks after a word's last letter are a word of their own, and so is one line end between a letter or mark and
        a letter. Only beside Latin-1 letters: others may end in a mark of their own when their case is folded.
        """
        joined = np.asarray(pc.or_(pc.match_substring_regex(words, f"[{MARKS}]$"), pc.match_substring(words, "\n")))
        at = np.flatnonzero(joined)
        at = at[~np.asarray(pc.match_substring_regex(words.take(pa.array(at)), UNCUT))]
        joined[:] = False
        joined[at] = True
        rest = np.flatnonzero(~joined)
        marked = pc.replace_substring_regex(words.take(pa.array(at)), f"([{LETTERS}])([{MARKS}]+)(\n|$)", rf"\1{CUT}\2\3")
        cut = pc.split_pattern(pc.replace_substring(marked, "\n", self.line), CUT)
        return np.concatenate([rest, at]), pa.concat_arrays([words.take(pa.array(rest)), cut.flatten()]), np.concatenate([np.ones(len(rest), np.int64), np.diff(np.asarray(cut.offsets))])

    def _known(self, parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of each part; those that are not remembered are made, each distinct one once."""
        held = pa.concat_batches([self.old, self.young])
        found = pc.index_in(parts, value_set=held["word"])
        new = parts.filter(found.is_null()).dictionary_encode()
        made, order = self._words(new.dictionary)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(held), len(held) + len(order))
        at = np.array(found.fill_null(-1))
        at[at < 0] = place[np.asarray(new.indices)]
        every = pa.concat_batches([held, made])
        met = np.zeros(len(every), bool)
        met[at] = True
        olds, news = np.arange(len(self.old)), np.arange(len(self.old), len(held))
        olds = np.concatenate([olds[~met[olds]], olds[met[olds]], news[met[news]]])[-self.remember :]
        news = np.concatenate([news[~met[news]], np.arange(len(held), len(every))])[-(2 * self.remember - len(olds)) :]
        self.old, self.young = every.take(pa.array(olds)), every.take(pa.array(news))
        return every["ids"].take(pa.array(at))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more entry than texts). A null is empty."""
        texts = pc.fill_null(texts, "")
        whole = np.asarray(pc.match_substring_regex(texts, RUN)) if self.keeps_spaces else np.zeros(len(texts), bool)
        for name in self.special:
            whole = whole | np.asarray(pc.match_substring(texts, name, ignore_case=True))
        if whole.any():
            direct = iter([np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)])
            ids, starts = self._fast(texts.filter(pa.array(~whole)))
            fast = iter([ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
            parts = [next(direct) if w else next(fast) for w in whole]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return self._fast(texts)

    def _fast(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.keeps_spaces:
            texts = pc.ascii_lower(texts)  # as this vocabulary's normaliser does; a slice that was cast comes out of it garbled
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds = np.asarray(split.offsets).astype(np.int64)
        bounds = bounds - bounds[0]
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, np.array(coded.indices)
        del split, coded
        if self.keeps_spaces:
            first = np.unique(codes[bounds[:-1]])  # the words that begin a text carry no space
            place = np.zeros(len(words), np.int32)
            place[first] = np.arange(len(first))
            codes[bounds[:-1]] = len(words) + place[codes[bounds[:-1]]]
            space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
            words = pa.concat_arrays([pc.binary_join_element_wise(space, words, nothing), words.take(pa.array(first))])
        order, parts, counts = self._parts(words)
        flat, at = numbers(self._known(parts))
        known = binaries(flat, at[np.cumsum(counts)])  # a word's parts lie in a row
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        ids, at = numbers(known.take(pa.array(place[codes])))
        return ids, at[bounds]


def runs(sizes: np.ndarray, most: int):
    """(from, to) ranges of rows whose sizes add up to at most ``most``, one row at least."""
    at = 0
    while at < len(sizes):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield at, to
        at = to


def slices(texts: pa.Array, most_bytes: int = 6 << 20):
    """(from, to) row ranges of at most ``most_bytes`` of text each, one row at least."""
    return runs(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64), most_bytes)


@lru_cache(maxsize=2)
def _encoder(name: str, keeps_spaces: bool, remember: int) -> Encoder:
    return Encoder(tokenizer_path(name), keeps_spaces, remember)


@contextmanager
def encoder(name: str, keeps_spaces: bool, remember: int = 250_000):
    """The worker's encoder for the length of a task. A worker outlives its task: what the task filled is given back to the system."""
    lent = _encoder(name, keeps_spaces, remember)
    try:
        yield lent
    finally:
        lent.forget()
        give_back()


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
