"""Token ids of whole texts with a public tokenizer, each distinct word encoded once.

Both vocabularies split a text before their merges, so ids of a text are the ids of its parts in
order. A part is a word (a run without ASCII white space; for the byte-level vocabulary with the one
space before it), the punctuation after it, or, for the byte-level vocabulary alone, what white
space is left between words. Parts of a slice of texts are hashed as one array, looked up in a hash
table of known ones, and their ids gathered; only parts not met yet reach the library.

* A word of plain Latin letters is one piece for the vocabulary's own pattern and unchanged by its
  normalizer but for capitals, so it goes to the library's merges alone. Every other part passes
  through the whole library.
* ASCII punctuation but the apostrophe, at a word's end and after a Latin letter or a digit, is always
  a piece of its own.
* Texts that hold a special token's string, and for the byte-level vocabulary texts with white space
  beyond ASCII, are given to the library whole.

The ids are those of the plain call, Tokenizer.from_file(path).encode(text, add_special_tokens=False).
Parts are told apart by 64-bit hashes within one process's table of at most MOST_PARTS."""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

from loomwright.llm.text import HashIndex, Words, grown, release, spread  # noqa: E402

#: Parts kept at most; some 50 bytes each.
MOST_PARTS = 1_200_000

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: The second bytes of Latin-1 letters, after 0xC3.
LATIN_TAIL = np.zeros(256, dtype=bool)
LATIN_TAIL[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[range(0x30, 0x3A)] = True
STOP = np.zeros(256, dtype=bool)
STOP[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

#: White space beyond ASCII, and what some libraries count as such.
ODD = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]")
#: The first bytes of such characters in UTF-8.
ODD_BYTES = np.zeros(256, dtype=bool)
ODD_BYTES[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

#: Joins words for the library; a word that has it is encoded alone.
JOINER = {"byte": "\n", "word": " \x01 "}
#: Tells a part after a space from the same part without one.
AFTER_SPACE = np.uint64(0x5851F42D4C957F2D)
#: Parts handed to the library as one sequence.
RUN = 256


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes in order for U+0100 and on. A space is left as it is: it parts words here."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest) if b != 0x20}


SPACE_LETTER = chr(0x120)
#: Stands between words; no plain word has it.
MARK_LETTER = chr(0x101)

_encoders: dict[str, "Encoder"] = {}


def encoder(name: str) -> "Encoder":
    """The process's encoder for a vocabulary file's name or path."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def drop_encoders() -> None:
    """Give back the encoders of the process and their tables; the next call of encoder starts anew."""
    _encoders.clear()
    release()


class Table:
    """Ids of parts by hash; a part's ids stand in one pool."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index, self.used = HashIndex(16), 0
        self.starts, self.sizes = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int32)
        #: The slice in which a part was learned, and that in which it was last asked for.
        self.born, self.asked = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)
        self.pool = np.zeros(1, dtype=np.uint32)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, now: int) -> None:
        """Distinct keys that are not there yet, with their ids one after another."""
        new = self.index.add(keys)
        self.starts, self.sizes, self.born, self.asked = (grown(x, self.index.n) for x in (self.starts, self.sizes, self.born, self.asked))
        self.sizes[new], self.born[new] = sizes, now
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.pool = grown(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def forget(self) -> None:
        """Keep parts that were asked for in a later slice too; all go if those are too many."""
        n = self.index.n
        keep = np.flatnonzero(self.asked[:n] > self.born[:n])
        keep = keep if 2 * len(keep) < MOST_PARTS else keep[:0]
        keys, sizes, asked = self.index.keys[keep], self.sizes[keep], self.asked[keep]
        ids = self.pool[spread(self.starts[keep], sizes)]
        self.clear()
        self.add(keys, ids, sizes, 0)
        self.born[: len(keep)] = asked


class Encoder:
    def __init__(self, name: str):
        self.library = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        self.kind = "word" if os.path.basename(name).startswith("word") else "byte"
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.joiner = JOINER[self.kind]
        (self.mark,) = self.ids(self.joiner.strip(" "))
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        (self.mark_letter,) = self.merges.encode(MARK_LETTER, add_special_tokens=False).ids
        self.letters = byte_letters()
        self.table, self.slice = Table(), 0
        self.spaces: dict[tuple[bytes, int], list[int]] = {}

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def odd(self, texts: list[bytes]) -> np.ndarray:
        """Which texts the library must see whole."""
        out = np.fromiter((any(s in t for s in self.special) for t in texts), dtype=bool, count=len(texts))
        if self.kind == "byte":
            for i, text in enumerate(texts):
                if not out[i] and ODD_BYTES[np.frombuffer(text, dtype=np.uint8)].any():
                    out[i] = ODD.search(text.decode()) is not None
        return out

    # -- parts the table has not got ------------------------------------------------------------

    def merged(self, words: list[bytes], after_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of plain letters, by the library's merges alone."""
        if not words:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        ids, sizes = [], []
        before = SPACE_LETTER if after_space else ""
        runs = []
        for k in range(0, len(words), RUN):
            run = b" ".join(words[k : k + RUN])
            run = run.decode().lower().encode() if self.kind == "word" else run
            runs.append(before + run.decode("latin-1").translate(self.letters).replace(" ", f" {MARK_LETTER} {before}"))
        for run in self.merges.encode_batch_fast(runs, add_special_tokens=False):
            found = np.array(run.ids, dtype=np.uint32)
            marks = np.flatnonzero(found == self.mark_letter)
            ids.append(np.delete(found, marks))
            sizes.append(np.diff(marks - np.arange(len(marks)), prepend=0, append=len(found) - len(marks)))
        return np.concatenate(ids), np.concatenate(sizes)

    def passed(self, words: list[bytes], after_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of any words, by the whole library."""
        before, joint = " " if after_space else "", self.joiner.strip(" ")
        alone = {k for k, w in enumerate(words) if joint.encode() in w or self.kind == "byte" and ODD.search(w.decode())}
        own = [before + w.decode() for w in words]
        together = [w for k, w in enumerate(own) if k not in alone]
        runs = [together[k : k + 64] for k in range(0, len(together), 64)]
        found: list[np.ndarray] = []
        for run, got in zip(runs, self.library.encode_batch_fast([self.joiner.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype=np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.mark))
            if len(parts) != len(run):
                raise ValueError("a word holds the joining token")
            found += [p[1:] if k else p for k, p in enumerate(parts)]
        rest = iter(found)
        lists = [np.array(self.ids(w), dtype=np.uint32) if k in alone else next(rest) for k, w in enumerate(own)]
        return np.concatenate([np.zeros(0, dtype=np.uint32), *lists]), np.array([len(x) for x in lists], dtype=np.int64)

    def know(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, after: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The place of each part in the table, which learns those it has not got."""
        table = self.table
        at = table.index.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if table.index.n + len(missing) > MOST_PARTS:
                table.forget()
                at = table.index.find(keys)
                missing = np.flatnonzero(at < 0)
            first = missing[np.unique(keys[missing], return_index=True)[1]]
            for after_space in (False, True):
                for how, easy in ((self.merged, True), (self.passed, False)):
                    new = first[(after[first] == after_space) & (plain[first] == easy)]
                    if len(new):
                        parts = [buffer[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                        table.add(keys[new], *how(parts, after_space), self.slice)
            at[missing] = table.index.find(keys[missing])
        table.asked[at] = self.slice
        return at

    # -- whole texts ----------------------------------------------------------------------------

    def gaps(self, words: Words, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """(order key, text, ids) of white space that no word takes with it; word i has the order key 3 i + 2."""
        firsts = np.zeros(len(words), dtype=bool)
        firsts[words.bounds[:-1][words.count > 0]] = True
        begin = np.concatenate([[0], words.ends[:-1]]) if len(words) else words.starts
        begin = np.where(firsts, words.base[:-1][words.doc], begin)
        end = words.starts - after
        inner = np.flatnonzero(end > begin)
        some = words.count > 0
        last = np.where(some, words.ends[np.maximum(words.bounds[1:] - 1, 0)] if len(words) else 0, words.base[:-1])
        outer = np.flatnonzero(words.base[:-1] + words.size > last)
        order = np.concatenate([3 * inner + 1, 3 * words.bounds[1:][outer]])
        doc = np.concatenate([words.doc[inner], outer])
        spans = [*zip(begin[inner].tolist(), end[inner].tolist(), after[inner].astype(int).tolist(), strict=True), *((a, b, 2) for a, b in zip(last[outer].tolist(), (words.base[:-1] + words.size)[outer].tolist(), strict=True))]
        ids = []
        for a, b, what in spans:
            key = (words.buffer[a:b], what)
            if key not in self.spaces:
                if len(self.spaces) > 10_000:
                    self.spaces.clear()
                # What follows tells how the run is cut: a word, a word with its space, nothing.
                follows = ("a", " a", "")[what]
                found = self.ids(key[0].decode() + follows)
                self.spaces[key] = found[:-1] if follows else found
            ids.append(self.spaces[key])
        return order, doc, ids

    def parts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word, plain): words cut before stops at their end, which stand after a letter or digit; plain: of Latin letters alone."""
        data = words.data
        tail = np.zeros(len(data), dtype=bool)
        tail[1:] = LATIN_TAIL[data[1:]] & (data[:-1] == 0xC3)
        letter = LETTER[data] | tail
        letter[:-1] |= tail[1:]
        body = words.ends.copy()
        stopped = np.flatnonzero(STOP[data[body - 1]])
        while len(stopped):
            body[stopped] -= 1
            stopped = stopped[(body[stopped] > words.starts[stopped])]
            stopped = stopped[STOP[data[body[stopped] - 1]]]
        last = data[np.maximum(body - 1, 0)]
        parted = (body > words.starts) & (body < words.ends) & (LETTER[last] | DIGIT[last] | tail[np.maximum(body - 1, 0)])
        body = np.where(parted, body, words.ends)
        order = np.arange(len(words)) + np.cumsum(parted) - parted
        extra = np.flatnonzero(parted)
        starts, ends, word = (np.empty(len(words) + len(extra), dtype=np.int64) for _ in range(3))
        starts[order], ends[order], word[order] = words.starts, body, np.arange(len(words))
        starts[order[extra] + 1], ends[order[extra] + 1], word[order[extra] + 1] = body[extra], words.ends[extra], extra
        # Bytes that are no letter, counted before each position.
        other = np.concatenate([[0], np.cumsum(~letter, dtype=np.int32)])
        return starts, ends, word, other[ends] == other[starts]

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has), each word after a space where the vocabulary minds it."""
        self.slice += 1
        found = Words([b" ".join(words)])
        starts, ends, word, plain = self.parts(found)
        keys = found.span_hashes(starts, ends)
        after = (starts == found.starts[word]) & (self.kind == "byte")
        at = self.know(found.buffer, starts, ends, np.where(after, keys ^ AFTER_SPACE, keys), after, plain)
        sizes = self.table.sizes[at].astype(np.int64)
        return self.table.pool[spread(self.table.starts[at], sizes)], np.bincount(word, weights=sizes, minlength=len(found)).astype(np.int64)

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds: the first of each text and the number of all); end, if given, closes each text."""
        self.slice += 1
        odd = self.odd(texts)
        words = Words([b"" if o else t for t, o in zip(texts, odd.tolist(), strict=True)] if odd.any() else texts)
        starts, ends, word, plain = self.parts(words)
        keys = words.span_hashes(starts, ends)
        after = np.zeros(len(word), dtype=bool)
        spaced = np.zeros(len(words), dtype=bool)
        if self.kind == "byte" and len(words):
            spaced = (words.starts > words.base[:-1][words.doc]) & (words.data[words.starts - 1] == 0x20)
            after = spaced[word] & (starts == words.starts[word])
            keys = np.where(after, keys ^ AFTER_SPACE, keys)
        at = self.know(words.buffer, starts, ends, keys, after, plain)
        begins, sizes, doc, pool = self.table.starts[at], self.table.sizes[at].astype(np.int64), words.doc[word], self.table.pool
        more: list[list[int]] = []
        order, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.kind == "byte":
            order, owner, more = self.gaps(words, spaced)
        for k in np.flatnonzero(odd).tolist():
            more.append(self.ids(texts[k].decode()))
            order, owner = np.append(order, 3 * words.bounds[k + 1]), np.append(owner, k)
        if end is not None:
            more += [[end]] * len(texts)
            order, owner = np.concatenate([order, 3 * words.bounds[1:]]), np.concatenate([owner, np.arange(len(texts))])
        if more:
            extra = np.fromiter(map(len, more), dtype=np.int64, count=len(more))
            ids = np.fromiter((x for m in more for x in m), dtype=np.uint32, count=int(extra.sum()))
            begins = np.concatenate([begins, self.table.used + np.cumsum(extra) - extra])
            pool = self.table.pool = grown(pool, self.table.used + len(ids))
            pool[self.table.used : self.table.used + len(ids)] = ids
            # Parts and the rest, each in order already, are merged by text and place.
            place = np.concatenate([3 * word + 2, order])
            sizes, doc = np.concatenate([sizes, extra]), np.concatenate([doc, owner])
            turn = np.argsort(doc * (3 * len(words) + 3) + place, kind="stable")
            begins, sizes, doc = begins[turn], sizes[turn], doc[turn]
        flat = pool[spread(begins, sizes)]
        return flat, np.concatenate([[0], np.cumsum(np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64))])
