"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, k: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_dups(rows: list[tuple[int, str | None]], k: int, threshold: int = 80) -> list[tuple]:
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict = {}
    for i, s in enumerate(sets):
        near: dict[int, int] = {}
        for x in s:
            for j in holders.get(x, ()):
                near[j] = near.get(j, 0) + 1
            holders.setdefault(x, []).append(i)
        for j, both in near.items():
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def line_base(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the contract's base rules, sorted; kinds 0 assign, 1 access, 2 hex."""
    text = text or ""
    key = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(key + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def repeated_spans(rows: list[tuple[int, str | None]], least: int) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) of unions of passages of ``least`` words that stand at two places."""
    holders: dict[tuple, set] = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - least + 1):
            holders.setdefault(tuple(w[i : i + least]), set()).add((d, i))
    out = []
    for d, w in words:
        for i in range(len(w) - least + 1):
            if len(holders[tuple(w[i : i + least])]) > 1:
                if out and out[-1][0] == d and i <= out[-1][2]:
                    out[-1] = (d, out[-1][1], i + least)
                else:
                    out.append((d, i, i + least))
    return sorted(out)
