"""Token ids of many texts, each distinct word encoded once.

A tokenizer that never joins what stands before a white space with what follows gives the same ids for a text and for its
pieces, cut before each run of white space. Pieces are found and hashed with numpy; only those not seen before in the Python
worker are handed to the tokenizer. Texts with white space outside ASCII are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from traceframe.llm.spans import _SPACE, Texts

#: Distinct pieces that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 3_000_000
#: Pieces that are handed to the tokenizer as one text.
JOINED = 5_000
#: White space outside ASCII (fixed values).
WIDE_SPACE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class PieceEncoder:
    """Encodes texts with ``encode``, which maps a list of strings to lists of ids; remembers pieces by their hash.

    sizes: the bytes that each id stands for. New pieces are encoded side by side, and the sizes tell where each one ends.
    whole: characters whose texts are encoded whole, as white space outside ASCII and what does not keep its size.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], sizes: np.ndarray, whole: str = WIDE_SPACE):
        self.encode, self.sizes, self.apart = encode, sizes, whole
        self.first = np.zeros(256, bool)
        self.first[[c.encode()[0] for c in whole]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, place: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces at the places where their sorted keys belong."""
        # a piece without space in front (a text's first) or with space at its end (a last one) would grow into its neighbour
        alone = np.array([not _SPACE[p[0]] or bool(_SPACE[p[-1]]) for p in pieces], bool)
        together = np.flatnonzero(~alone)
        size, at, flat = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [self.ids]
        filled = len(self.ids)
        for i, got in zip(np.flatnonzero(alone), self.encode([pieces[i].decode() for i in np.flatnonzero(alone)])):
            flat.append(np.array(got, np.int32))
            size[i], at[i], filled = len(got), filled, filled + len(got)
        parts = [together[i : i + JOINED] for i in range(0, len(together), JOINED)]
        for part, got in zip(parts, self.encode([b"".join([pieces[i] for i in part]).decode() for part in parts])):
            flat.append(np.array(got, np.int32))
            lengths = np.fromiter((len(pieces[i]) for i in part), np.int64, len(part))
            ends = np.searchsorted(np.cumsum(self.sizes[flat[-1]]), np.cumsum(lengths)) + 1
            size[part], at[part] = np.diff(ends, prepend=0), filled + np.append(0, ends[:-1])
            filled += len(got)
        self.ids = np.concatenate(flat)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def __call__(self, texts: Texts) -> list[np.ndarray]:
        """The ids of each text."""
        data, n = texts.data, texts.n
        space = _SPACE[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = space[1:] & ~space[:-1]
        begin[texts.bounds] = True
        begin[-1] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        of = np.searchsorted(texts.bounds, starts, "right") - 1
        whole = np.zeros(n, bool)
        maybe = np.unique(np.searchsorted(texts.bounds, np.flatnonzero(self.first[data]), "right") - 1)
        for i in maybe:
            text = data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()
            whole[i] = any(c in text for c in self.apart)
        if whole.any():
            cut = ~whole[of]
            starts, ends, of = starts[cut], ends[cut], of[cut]
        keys = texts.hashes(starts, ends)
        if len(self.keys) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.forget()
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        if new.any():
            blob = data.tobytes()
            self._learn(distinct[new], place[new], [blob[starts[i] : ends[i]] for i in first[new]])
            place = np.searchsorted(self.keys, distinct)
        at, size = self.at[place][back], self.size[place][back]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        cuts = total[np.searchsorted(of, np.arange(n + 1))]
        out = [flat[cuts[i] : cuts[i + 1]] for i in range(n)]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.encode([data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()])[0], np.int32)
        return out
