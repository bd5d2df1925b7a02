"""Deep-shallow ordering of many small groups of byte strings, and anchors that equal passages share (numpy, inside tasks)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import MASK
from .shingles import mix


@dataclass(frozen=True)
class Passage:
    """What counts as a passage: `length` bytes and more. Anchors are grams of a quarter of that; `window` grams lie in one passage."""

    length: int = 400

    def __post_init__(self) -> None:
        if not 32 <= self.length < 1024:
            raise ValueError("a passage has 32 to 1023 bytes")

    @property
    def gram(self) -> int:
        return self.length // 4

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


PASSAGE = Passage()
SHALLOW = 64                  # bytes ordered by multikey sorting before blind tries take over
PIECE = 1 << 16               # passage starts looked at together; bounds the memory for long texts

_BASE = 0x5851F42D4C957F2D
_random = np.random.default_rng(77)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_UNIT = np.ones(1, dtype=np.uint64)
_span = PIECE + 1024
_POWER = np.concatenate([_UNIT, np.cumprod(np.full(_span, _BASE, dtype=np.uint64))])
_BACK = np.concatenate([_UNIT, np.cumprod(np.full(_span, pow(_BASE, -1, MASK + 1), dtype=np.uint64))])


def gram_hashes(data: np.ndarray, gram: int = PASSAGE.gram) -> np.ndarray:
    """A 64-bit hash of every `gram` bytes, from prefix sums of a polynomial."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POWER[:len(data)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _BACK[:len(data) - gram + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(MASK), dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(text: bytes, passage: Passage = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, left, right): the least gram of every passage, ties included.

    Equal passages have the same anchors at the same distance from their start. The passages that an
    anchor stands for lie within `left` bytes before and `right` bytes after its position.
    """
    length, window = passage.length, passage.window
    found: list[list[np.ndarray]] = [[], [], [], []]
    for begin in range(0, len(text) - length + 1, PIECE):
        data = np.frombuffer(text, dtype=np.uint8, offset=begin, count=min(PIECE + length - 1, len(text) - begin))
        grams = gram_hashes(data, passage.gram)
        least = sliding_min(grams, window)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(least)]]) - 1
        edge = np.full(window - 1, MASK, dtype=np.uint64)
        highest = ~sliding_min(np.concatenate([edge, ~least, edge]), window)
        at = np.flatnonzero(highest == grams)
        run = np.searchsorted(last, at - window + 1)
        while (wrong := least[first[run]] != grams[at]).any():  # the run of passages with this least value
            run[wrong] += 1
        for part, values in zip(found, (at + begin, grams[at].view(np.int64), at - np.maximum(first[run], at - window + 1),
                                        np.minimum(last[run], at) + length - at), strict=True):
            part.append(values)
    return tuple(np.concatenate(p) if p else np.empty(0, dtype=np.int64) for p in found)


def _common(one: bytes, other: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    differ = int.from_bytes(one, "big") ^ int.from_bytes(other, "big")
    return len(one) - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of distinct strings of one length, and the common prefix of each with the one before it (0 for the first).

    Inner nodes hold only a depth and the branching bytes. An insertion walks down blindly to some leaf,
    compares whole strings once, and then branches off where they differ.
    """
    root: int | list = 0
    for new in range(1, len(strings)):
        text, node = strings[new], root
        while isinstance(node, list):
            node = node[1].get(text[node[0]]) if text[node[0]] in node[1] else next(iter(node[1].values()))
        known = strings[node]
        depth = _common(text, known)
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][text[depth]] = new
            continue
        branch = [depth, {known[depth]: node, text[depth]: new}]
        if above is None:
            root = branch
        else:
            above[1][text[above[0]]] = branch
    order: list[int] = []
    shared: list[int] = []
    walk: list[tuple[int | list, int]] = [(root, 0)]
    while walk:
        node, with_last = walk.pop()
        if isinstance(node, list):
            keys = sorted(node[1])
            walk.extend((node[1][k], node[0] if k != keys[0] else with_last) for k in reversed(keys))
        else:
            order.append(node)
            shared.append(with_last)
    return order, shared


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted within their groups, and each one's common prefix with the row before.

    `rows` has one string of equal width per row, a multiple of 8 bytes; `group` is ascending. At the start
    of a group `common` is -1. Multikey sorting takes 8 bytes as one symbol and splits all groups at once;
    what still agrees after `SHALLOW` bytes goes to one blind trie per group.
    """
    n, width = rows.shape
    symbols = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, part = np.arange(n), group.copy()
    common = np.full(n, width, dtype=np.int64)
    common[np.flatnonzero(np.diff(part, prepend=part[:1] - 1))] = -1

    def many() -> np.ndarray:
        same = part[1:] == part[:-1]
        return np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))

    for depth in range(0, min(SHALLOW, width), 8):
        at = many()
        if not len(at):
            return order, common
        key = symbols[order[at], depth // 8]
        move = np.lexsort((key, part[at]))
        order[at], key = order[at[move]], key[move]
        new = np.flatnonzero((part[at[1:]] == part[at[:-1]]) & (key[1:] != key[:-1])) + 1
        differ = key[new] ^ key[new - 1]
        common[at[new]] = depth + sum((differ >> np.uint64(64 - 8 * k)) == 0 for k in range(1, 8))
        part = np.cumsum(common < depth + 8)
    at = many()
    if not len(at):
        return order, common
    bounds = np.flatnonzero(np.diff(part[at], prepend=part[at[:1]] - 1, append=part[at[-1]] + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        first, equal = at[a], {}
        for row in order[at[a:b]]:
            equal.setdefault(rows[row, SHALLOW:].tobytes(), []).append(row)
        strings = list(equal)
        for k, shared in zip(*blind_trie(strings), strict=True):
            same = equal[strings[k]]
            order[first:first + len(same)] = same
            if first != at[a]:
                common[first] = SHALLOW + shared
            first += len(same)
    return order, common


def repeated(group: np.ndarray, flat: np.ndarray, offset: np.ndarray, left: np.ndarray, right: np.ndarray,
             passage: Passage = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, farthest) distance of an anchor from the start of a passage that occurs at another anchor of its group; -1 for none.

    Row i has `left[i]` bytes before and `right[i]` bytes from its anchor on, which is `flat[offset[i] + left[i]]`.
    Both sides are ordered by deep-shallow sorting, the left one backwards. A passage that starts d bytes before
    the anchor occurs twice where two rows agree in d bytes to the left and in length - d to the right.
    """
    n, length = len(group), passage.length
    at, end = offset + left, len(flat) - 1
    ahead, back = np.arange((length + 7) // 8 * 8), np.arange((passage.window + 6) // 8 * 8)
    after = np.where(ahead < right[:, None], flat[np.minimum(at[:, None] + ahead, end)], 0).astype(np.uint8)
    before = np.where(back < left[:, None], flat[np.maximum(at[:, None] - 1 - back, 0)], 0).astype(np.uint8)
    right_order, right_common = deep_shallow(after, group)
    left_order, left_common = deep_shallow(before, group)
    nearest, farthest = np.full(n, -1), np.full(n, -1)
    left_class, right_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(passage.window):
        own = np.flatnonzero((left >= d) & (right >= length - d))
        if len(own) < 2:
            continue
        left_class[left_order] = np.cumsum(left_common < d)
        right_class[right_order] = np.cumsum(right_common < length - d)
        key = left_class[own] * (n + 1) + right_class[own]
        sort = np.argsort(key, kind="stable")
        same = key[sort[1:]] == key[sort[:-1]]
        twice = own[sort[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        farthest[twice] = d
        nearest[twice[nearest[twice] < 0]] = d
    return nearest, farthest
