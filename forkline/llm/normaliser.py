"""The first transducer of a SentencePiece model: its table of characters, applied to the longest stretch at each place."""

from __future__ import annotations

import re

import numpy as np


def character_table(charsmap: bytes) -> dict[str, str]:
    """What the normaliser rewrites, read off the model's table: a double-array trie, then the texts its leaves point to.

    A node holds the byte that leads to it, whether a value hangs there, and the offset by which, with the next byte,
    its successors are found.
    """
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, texts = np.frombuffer(charsmap, np.uint32, size // 4, 4), charsmap[4 + size :]
    label, has_value = units & np.uint32(0x800000FF), (units >> 8) & 1
    offset = ((units >> np.uint32(10)) << ((units & np.uint32(1 << 9)) >> np.uint32(6))).astype(np.int64)
    byte, table, open_nodes = np.arange(1, 256), {}, [(0, b"")]
    while open_nodes:
        at, key = open_nodes.pop()
        base = at ^ int(offset[at])
        if key and has_value[at]:
            start = int(units[base]) & 0x7FFFFFFF
            table[key.decode()] = texts[start : texts.index(b"\0", start)].decode()
        after = base ^ byte
        there = after < len(units)
        hits = byte[there][label[after[there]] == byte[there]]
        open_nodes += [(base ^ int(b), key + bytes([b])) for b in hits]
    return table


class Normaliser:
    """Rewrites the longest stretch of the table at each place, from left to right; other characters pass."""

    def __init__(self, charsmap: bytes):
        self.table = table = character_table(charsmap)
        lengths: dict[str, set[int]] = {}
        for key in table:
            lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {ch: sorted(n, reverse=True) for ch, n in lengths.items()}
        self.first = re.compile(f"[{re.escape(''.join(lengths))}]") if lengths else None

    def __call__(self, text: str) -> str:
        if self.first is None:
            return text
        out, done = [], 0
        for m in self.first.finditer(text):
            at = m.start()
            if at < done:
                continue
            for n in self.lengths[m.group()]:
                new = self.table.get(text[at : at + n])
                if new is not None:
                    out += (text[done:at], new)
                    done = at + n
                    break
        return "".join([*out, text[done:]]) if out else text
