"""Tokenisation with a ready-made vocabulary, one library call per distinct unit of text.

Both vocabularies split text before merging, and no piece of such a split crosses the edges
used here: before a space, around a line end, between a plain letter and a final mark. So a text's
ids are the ids of its units in order, and each distinct unit needs to go through the library
once per worker. Documents where that would not hold (two white-space characters side by
side, for a vocabulary that keeps spaces) go through the library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the vocabularies' patterns see it, a superset in RE2's notation.
_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Edge between units while a text is cut; texts that contain it go through whole.
_EDGE = "\x01"
_AMBIGUOUS = f"{_SPACE}{_SPACE}|{_EDGE}"
#: The letters that stand for bytes in byte-level vocabularies: printable bytes for
#: themselves, the others for code points from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: A final mark is cut off only behind letters whose normal form, in every case and Unicode
#: version, ends in a letter: Latin, Greek and Cyrillic ones without the dotted capital I, which
#: one vocabulary turns into a letter and a combining dot that stays with the mark.
_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{391}-\x{3A1}\x{3A3}-\x{3C9}\x{410}-\x{44F}])([.,])([ \n])"


class Encoder:
    """``keeps_space``: a single space belongs to the unit it precedes; else separators vanish.

    ``cache_units`` bounds the worker's memory: the cache has two halves, a full young half
    becomes the old one, and what is used again moves to the young one.
    """

    def __init__(self, path: str, keeps_space: bool, end_id: int, cache_units: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pa.set_memory_pool(pa.system_memory_pool())  # gives back at once what a batch has used
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.keeps_space, self.end_id, self.cache_units = keeps_space, end_id, cache_units
        self.model = self.library.model
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # ids as 32-bit integers; bytes cost the collector nothing

    def _plain(self, unit: str) -> str | None:
        """The unit as the merges see it, if it is one word of Latin letters; else None.

        Such a unit needs neither the library's normaliser nor its patterns.
        """
        word = unit[1:] if self.keeps_space and unit[:1] == " " else unit
        if not word.isalpha() or max(word) >= "\u0100":
            return None
        if not self.keeps_space:  # this vocabulary is of lower case
            unit = word.lower()
        return unit.encode().decode("latin-1").translate(_BYTE_LETTERS)

    def _ids(self, texts: list[str]) -> list[bytes]:
        model, out, rest = self.model, [], []
        for text in texts:
            plain = self._plain(text)
            if plain is None:
                rest.append(len(out))
                out.append(b"")
            else:
                out.append(array("i", [t.id for t in model.tokenize(plain)]).tobytes())
        if rest:
            for k, x in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = array("i", x.ids).tobytes()
        return out

    def _resolve(self, units: list[str]) -> list[bytes]:
        if len(self.cache) > self.cache_units // 2:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        found = list(map(cache.get, units))
        late = [k for k, x in enumerate(found) if x is None]
        wanted = []
        for k in late:
            x = old.get(units[k])
            if x is None:
                wanted.append(units[k])
            else:
                cache[units[k]] = x
        cache.update(zip(wanted, self._ids(wanted)))
        for k in late:
            found[k] = cache[units[k]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each closed by the end id, and the offsets of each text."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = np.zeros(n, bool)
        if self.keeps_space:
            whole = pc.match_substring_regex(texts, _AMBIGUOUS).to_numpy(zero_copy_only=False)
            cut = pc.replace_substring_regex(texts, _MARK, rf"\1{_EDGE}\2\3")
            cut = pc.replace_substring(pc.replace_substring(cut, " ", _EDGE + " "), "\n", f"{_EDGE}\n{_EDGE}")
            lists = pc.split_pattern(cut, _EDGE)
        else:
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _MARK, r"\1 \2\3"))
        per_doc = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = self._resolve(coded.dictionary.to_pylist())
        end = len(pieces)
        if whole.any():
            codes = codes[~np.repeat(whole, per_doc)]
            per_doc = np.where(whole, 0, per_doc)
        # After the units: one piece for the end id, then the texts that go through whole.
        rows = np.flatnonzero(whole)
        pieces = [*pieces, array("i", [self.end_id]).tobytes(), *self._ids(texts.take(pa.array(rows)).to_pylist())]
        order = self._close(codes, np.cumsum(per_doc), rows, end, n)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.int32)
        begin = np.cumsum(lens) - lens
        take = lens[order]
        total = int(take.sum())
        at = np.cumsum(take) - take
        ids = flat[np.repeat(begin[order] - at, take) + np.arange(total)]
        bounds = np.concatenate([[0], np.flatnonzero(order == end) + 1])
        ends = np.concatenate([at, [total]])
        return ids, ends[bounds]

    @staticmethod
    def _close(codes, stops, rows, end, n):
        """Units with, after each text's units, its whole-text piece if it has one, then the end."""
        is_whole = np.zeros(n, np.int64)
        is_whole[rows] = 1
        extra = np.empty(n + len(rows), np.int64)
        where = np.repeat(stops, 1 + is_whole)
        last = np.cumsum(1 + is_whole) - 1
        extra[:] = -1
        extra[last] = end
        extra[extra < 0] = end + 1 + np.arange(len(rows))
        return np.insert(codes, where, extra)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, keeps_space: bool, end_id: int, cache_units: int = 500_000) -> Encoder:
    """The worker's encoder: its cache serves all tasks that the worker runs."""
    key = (path, keeps_space, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keeps_space, end_id)
    _ENCODERS[key].cache_units = cache_units
    return _ENCODERS[key]


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies; the package that holds them tells."""
    import public_tokenizers

    return public_tokenizers.path(name)
