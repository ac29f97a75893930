"""SHA-256 on many inputs at once, with states that can be kept and resumed.

A state is eight 32-bit words; ``compress`` takes it over one block of 64 bytes.  The hex text
of a digest is exactly one block, so a node of a Merkle tree is one block for each child and a
last one of padding, and the state before a child's block is all that a later fold needs of the
children to its left.
"""

from __future__ import annotations

import math

import numpy as np

FANOUT = 3  # children of a node


def _primes(n: int) -> list[int]:
    found, x = [], 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r**3 > x:
        r -= (r**3 - x) // (3 * r * r) + 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


_WORD = (1 << 32) - 1
#: First 32 bits of the fractions of the cube roots of 64 primes, and of the square roots of eight.
_ROUND = [np.uint32(_cube_root(p << 96) & _WORD) for p in _primes(64)]
START = np.array([[math.isqrt(p << 64) & _WORD] for p in _primes(8)], dtype=np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States ``(8, n)`` after blocks ``(16, n)`` of big-endian words; either may have one column for all."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        up = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + _ROUND[t])
        mixed = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = up + mixed, a, b, c, d + up, e, f, g
    return np.stack([x + y for x, y in zip((a, b, c, d, e, f, g, h), state, strict=True)])


def _padding(children: int) -> np.ndarray:
    data = b"\x80" + bytes(55) + (512 * children).to_bytes(8, "big")
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(16, 1)


PADDING = {c: _padding(c) for c in range(1, FANOUT + 1)}


def to_bytes(digests: np.ndarray) -> bytes:
    """Digests or states ``(8, n)`` one after the other."""
    return digests.T.astype(">u4").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").reshape(-1, 8).T.astype(np.uint32)


def hex_text(digests: np.ndarray) -> bytes:
    """Hex texts of digests, 64 bytes each."""
    return _HEX[np.frombuffer(to_bytes(digests), np.uint8)].tobytes()


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block ``(16, n)`` that the hex text of each digest is."""
    return np.frombuffer(hex_text(digests), ">u4").reshape(-1, 16).T.astype(np.uint32)


class Subtree:
    """Nodes of some levels above a run of leaves; parents keep the state before each child slot.

    ``levels``: exactly so many; None: until one node remains.  The last run of a level may have
    one or two children.
    """

    def __init__(self, leaves: np.ndarray, levels: int | None = None):
        self.nodes, self.states = [leaves], []
        while len(self.states) < levels if levels is not None else self.nodes[-1].shape[1] > 1:
            child = self.nodes[-1]
            n = child.shape[1]
            parents = -(-n // FANOUT)
            block, state = hex_block(child), np.repeat(START, parents, axis=1)
            before = np.empty((FANOUT, 8, parents), np.uint32)
            for slot in range(FANOUT):
                before[slot] = state
                some = len(range(slot, n, FANOUT))  # all parents, or all but the last one
                if some:
                    state[:, :some] = compress(state[:, :some], block[:, slot::FANOUT])
            last = n - FANOUT * (parents - 1)
            state = np.hstack([compress(state[:, :-1], PADDING[FANOUT]), compress(state[:, -1:], PADDING[last])])
            self.nodes.append(state)
            self.states.append(before)

    @property
    def root(self) -> np.ndarray:
        return self.nodes[-1]

    def pack(self) -> tuple[bytes, bytes]:
        """All nodes, and all kept states, as bytes."""
        return b"".join(map(to_bytes, self.nodes)), b"".join(to_bytes(x) for s in self.states for x in s)

    @classmethod
    def unpack(cls, leaves: int, levels: int, nodes: bytes, states: bytes) -> Subtree:
        tree, all_nodes, all_states, a, b = cls.__new__(cls), from_bytes(nodes), from_bytes(states), 0, 0
        tree.nodes, tree.states, width = [], [], leaves
        for level in range(levels + 1):
            tree.nodes.append(all_nodes[:, a : a + width])
            a += width
            if level < levels:
                width = -(-width // FANOUT)
                tree.states.append(all_states[:, b : b + FANOUT * width].reshape(8, FANOUT, width).swapaxes(0, 1))
                b += FANOUT * width
        return tree

    def fold(self, leaves: np.ndarray) -> np.ndarray:
        """The root ``(8, n)`` that results if each leaf alone is replaced.

        Each level resumes the parent's state before the leaf's slot with the replacement, then
        the siblings to its right, then the padding; siblings to the left are never hashed again.
        """
        now, at = leaves, np.arange(leaves.shape[1])
        for child, before in zip(self.nodes, self.states, strict=False):
            slot, parent, width, block = at % FANOUT, at // FANOUT, child.shape[1], hex_block(child)
            state = compress(before[slot, :, parent].T, hex_block(now))
            for s in range(1, FANOUT):
                right = FANOUT * parent + s
                have = (s > slot) & (right < width)
                if have.any():
                    state[:, have] = compress(state[:, have], block[:, right[have]])
            children = np.minimum(FANOUT, width - FANOUT * parent)
            for c in np.unique(children).tolist():
                state[:, children == c] = compress(state[:, children == c], PADDING[c])
            now, at = state, parent
        return now

    def above(self, step, end):
        """For each leaf ``step(level, slot, children) + ... `` of all its levels, then ``end``."""
        tails = [end]
        for level in reversed(range(len(self.states))):
            width = self.nodes[level].shape[1]
            tails = [step(level, i % FANOUT, i // FANOUT, min(FANOUT, width - i + i % FANOUT)) + tails[i // FANOUT] for i in range(width)]
        return tails

    def proofs(self, end: bytes) -> list[bytes]:
        """Hex texts of each leaf's siblings, level by level, left to right, then ``end``."""
        texts = [hex_text(n) for n in self.nodes]

        def step(level, slot, parent, children):
            at = 64 * FANOUT * parent
            return texts[level][at : at + 64 * slot] + texts[level][at + 64 * (slot + 1) : at + 64 * children]

        return self.above(step, end)

    def paths(self, end: bytes) -> list[bytes]:
        """What a fold above this subtree needs for each leaf: per level slot, children, state before the slot, siblings."""
        nodes = [to_bytes(n) for n in self.nodes]
        states = [[to_bytes(x) for x in s] for s in self.states]

        def step(level, slot, parent, children):
            at = 32 * FANOUT * parent
            state = states[level][slot][32 * parent : 32 * (parent + 1)]
            return bytes([slot, children]) + state + nodes[level][at : at + 32 * slot] + nodes[level][at + 32 * (slot + 1) : at + 32 * children]

        return self.above(step, end)


class Path:
    """The levels above a subtree, read from ``Subtree.paths``; the same for all its leaves."""

    def __init__(self, data: bytes):
        self.steps, self.proof, at = [], b"", 0
        while at < len(data):
            slot, children = data[at], data[at + 1]
            state, siblings = from_bytes(data[at + 2 : at + 34]), from_bytes(data[at + 34 : at + 34 + 32 * (children - 1)])
            self.proof += hex_text(siblings)
            self.steps.append((state, [hex_block(siblings[:, i : i + 1]) for i in range(slot, children - 1)], children))
            at += 34 + 32 * (children - 1)

    def fold(self, digests: np.ndarray) -> np.ndarray:
        for state, right, children in self.steps:
            digests = compress(state, hex_block(digests))
            for block in right:
                digests = compress(digests, block)
            digests = compress(digests, PADDING[children])
        return digests
