"""Weighted string similarity, 0 to 100, from its published definition: the best of a whole-string, a token-sorted, a
token-set and, for strings of unlike length, a partial ratio, each with its weight."""

from __future__ import annotations

import re


def clean(raw: str) -> str:
    return " ".join(re.sub(r"[^a-zA-Z0-9\s+#./]", " ", raw.strip().lower()).split())


def _places(s: str) -> dict[str, int]:
    """For each character the places where it stands, as bits."""
    out: dict[str, int] = {}
    for j, y in enumerate(s):
        out[y] = out.get(y, 0) | 1 << j
    return out


def _common(a: str, places: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and a string of length n with these places, a whole row of the table at a
    time: a bit of ``free`` is 0 where the row's value grows by one."""
    full = (1 << n) - 1
    free = full
    for x in a:
        hit = free & places.get(x, 0)
        free = (free + hit | free - hit) & full
    return n - free.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, _places(b), len(b)) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of at most its length."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n, places = len(short), _places(short)
    stretches = (long[max(i, 0) : i + n] for i in range(1 - n, len(long)))
    return max(200.0 * _common(s, places, n) / (n + len(s)) for s in stretches)


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    one, two = (f"{both} {s}".strip() for s in (left, right))
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


def _partial_token(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if times < 1.5:
        return max(best, 0.95 * max(ratio(_sorted(a), _sorted(b)), token_set_ratio(a, b)))
    scale = 0.9 if times <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * _partial_token(a, b))


def best_match(raw: str, names: tuple[str, ...], least: float) -> str | None:
    """The first of the names most alike, if it is alike enough. Names are compared as they are written."""
    text = clean(raw)
    if len(text) < 2:
        return None
    # Strings of which one is over eight times as long as the other reach 60 at most.
    near = [(i, n) for i, n in enumerate(names) if least <= 60 or max(len(text), len(n)) <= 8 * min(len(text), len(n))]
    score, _, name = max(((wratio(text, n), -i, n) for i, n in near), default=(0.0, 0, ""))
    return name if near and score >= least else None
