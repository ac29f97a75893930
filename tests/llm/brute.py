"""Plain Python versions of the contracts, for comparison on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd

TABLES = "/root/testdata/sf0.001"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    starts, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def _luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(text):
    spans = []
    for k, (kind, pattern) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), k, m.end(), kind))
    return sorted(spans)


def base_digest(text):
    return sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in pii(text)))


def chat(rows):
    """``rows``: (conv_id, turn, role, text) -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        out[conv] = (len(own), sha("".join(f"{role}\n{t or ''}\n" for _, _, role, t in own)), len(loss), sha(loss))
    return out


def crc_mod(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def read(name, folder=TABLES):
    return pd.read_parquet(f"{folder}/{name}.parquet")


def u32(ids):
    return np.array(ids, dtype="<u4").tobytes()
