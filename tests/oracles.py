"""A small plain-Python oracle for greedy merging."""

from __future__ import annotations


def greedy_pieces(token: str, ranks: dict[tuple[str, str], int]):
    """Repeat: join the adjacent pair with the least (rank, place)."""
    parts, merges = [*token], 0
    while True:
        options = [
            (ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks
        ]
        if not options:
            return parts, merges
        _, i = min(options)
        parts[i : i + 2] = ["".join(parts[i : i + 2])]
        merges += 1
