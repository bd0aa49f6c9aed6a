"""Plain single-machine versions of the operators' contracts, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

BLANK = b" \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]


def simhash(text: str | None, k: int = 3) -> int:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(len(w) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows: list[tuple], bits: int = 3) -> dict:
    """doc_id -> (fingerprint, smallest reachable id), comparing all pairs."""
    fps = {d: simhash(t) for d, t in rows}
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def personal_data(text: str | None) -> list[tuple[str, int, int]]:
    t, out = text or "", []
    out += [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t)
            if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def substring_dedup(rows: list[tuple], k: int = 13) -> list[tuple]:
    first: dict[tuple, int] = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            f = first.get(tuple(w[i:i + k]))
            if f is not None and (d is None or f < d):
                gone[i:i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def token_ids(texts: list[str | None], path: str) -> list[list[int]]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def crc_ids(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def fim(doc_id, text: str | None) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return len(units), "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def periodic_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period), comparing all words at every distance."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 4 + 1):
        j = 0
        while j < len(w) - q:
            k = j
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k - j + q >= max(6, 4 * q):
                found.setdefault((j, k - j + q), q)
            j = max(k, j + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))
