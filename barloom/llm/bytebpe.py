"""Ids of texts under a byte-level BPE vocabulary, one encoding per distinct word of a batch.

The vocabulary's pattern parts a text before every space or line feed that stands
between other characters, so a text is cut into chunks, a word with the space or line
feed before it, and equal chunks have equal ids. Texts in which white space comes in
longer runs are encoded whole; ``ODD`` tells them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the pattern by which byte-level vocabularies part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = r"\t-\r \x{85}\p{Z}"
_MARK = "\x01"
#: Texts that aren't cut: a space or line feed between white space or between that and the end, or the mark itself.
ODD = rf"[{_SPACES}][ \n](?:[{_SPACES}]|\z)|{_MARK}"
#: Words that both libraries part alike: printable ASCII and Latin letters.
_PLAIN = r"^ ?[!-~\x{A1}-\x{AC}\x{AE}-\x{24F}]+$"
#: A line feed that no other white space follows: a token of its own.
_LINED = rf"^\n(?:[^{_SPACES}]|\z)"


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1
    for itself, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunked(texts: pa.Array) -> pa.ListArray:
    """The texts cut before every space and line feed."""
    return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", f"{_MARK} "), "\n", f"{_MARK}\n"), _MARK)


def bounds(sizes: np.ndarray) -> np.ndarray:
    """Where each of the lists of these sizes begins, and where the last ends."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gathered(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``which`` of those that begin at ``at`` in ``flat``, and where each then begins."""
    size = (at[1:] - at[:-1])[which]
    to = bounds(size)
    return flat[np.repeat(at[which] - to[:-1], size) + np.arange(to[-1])], to


class ByteEncoder:
    """Ids under the vocabulary file ``path`` of the tokenizers library. With ``specials``
    strings of special tokens become these tokens, else they are ordinary text."""

    def __init__(self, path: str, *, specials: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        #: Type of whole numbers that every id fits in.
        self.width = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.line = 0
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary as ranks, if ids are in the order of the merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters, vocabulary, level = byte_of_letter(), made["model"]["vocab"], made.get("pre_tokenizer") or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        added = {t["content"] for t in made.get("added_tokens", ())}
        by_pattern = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and not made.get("normalizer")
        if not by_pattern or [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {bytes(letters[c] for c in token): n for token, n in vocabulary.items() if token not in added}
        self.line = ranks[b"\n"]
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each begins), each text encoded whole."""
        own = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        at = bounds(np.fromiter(map(len, own), np.int64, len(own)))
        return np.fromiter((i for ids in own for i in ids), np.uint32, at[-1]), at

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``whole`` for chunks without a line feed before them: the plain ones together,
        a line feed, which is a pre-token and an id of its own, between them."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        some, rest = words.filter(pa.array(plain)), words.filter(pa.array(~plain))
        flat, at = np.empty(0, np.uint32), np.zeros(1, np.int64)
        if len(some):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_py()
            ids = self.ranked.encode_to_numpy(joined, disallowed_special=())
            cut = np.flatnonzero(ids == self.line)
            flat, at = np.delete(ids, cut), bounds(np.diff(np.r_[-1, cut, len(ids)]) - 1)
        if len(rest):
            more, then = self.whole(rest.to_pylist())
            flat, at = np.concatenate([flat, more]), np.concatenate([at, at[-1] + then[1:]])
        place = np.empty(len(words), np.int64)
        place[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(words))
        return gathered(flat, at, place)

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``whole`` for distinct chunks."""
        lined = pc.match_substring_regex(chunks, _LINED)
        flat, at = self.words(pc.if_else(lined, pc.utf8_slice_codeunits(chunks, 1), chunks))
        lines = np.flatnonzero(lined.to_numpy(zero_copy_only=False))
        return np.insert(flat, at[lines], self.line), at + np.searchsorted(lines, np.arange(len(at)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null: none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD) if self.ranked else pc.is_valid(texts)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        cut = chunked(pc.if_else(odd, "", texts))
        coded = cut.flatten().dictionary_encode()
        ids, at = gathered(*self.chunks(coded.dictionary), coded.indices.to_numpy())
        bound = at[bounds(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(which):
            more, then = self.whole(texts.take(pa.array(which)).to_pylist())
            place = np.arange(len(texts))
            place[which] = len(texts) + np.arange(len(which))
            ids, bound = gathered(np.concatenate([ids, more]), np.concatenate([bound, bound[-1] + then[1:]]), place)
        return ids, np.diff(bound)


_ENCODERS: dict[tuple[str, bool], ByteEncoder] = {}


def encoder(path: str, *, specials: bool = True) -> ByteEncoder:
    """This worker's encoder for a vocabulary file."""
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = ByteEncoder(path, specials=specials)
    return _ENCODERS[path, specials]
