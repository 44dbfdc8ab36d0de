"""Complete paths through combinatorial folds.

Each (combination, group) belongs to one of C(n - 1, k - 1) paths, so that every path tests each group once:
a proper colouring of the edges between combinations and groups, found by swapping alternating chains. The
number of combinations is bounded, so this is planning on the driver; the result is a lookup table.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession

from tidegate.errors import SplitError


def path_table(choices: list[tuple[int, ...]], n_groups: int) -> list[tuple[int, int, int]]:
    """(combination, group, path) in the order of combinations and groups."""
    colours = comb(n_groups - 1, len(choices[0]) - 1)
    at_combo: list[dict[int, int]] = [{} for _ in choices]  # colour -> group
    at_group: list[dict[int, int]] = [{} for _ in range(n_groups)]  # colour -> combination

    def free(used: dict[int, int]) -> int:
        return next(c for c in range(colours + 1) if c not in used)

    for combo, groups in enumerate(choices):
        for group in groups:
            both = [c for c in range(colours) if c not in at_combo[combo] and c not in at_group[group]]
            if both:
                colour = both[0]
            else:
                here, colour = free(at_combo[combo]), free(at_group[group])
                # walk the chain that leaves the combination by `colour`, and exchange the two colours on it
                chain, on_combo, node, want = [], True, combo, colour
                while (other := (at_combo if on_combo else at_group)[node].get(want)) is not None:
                    chain.append((node, other, want) if on_combo else (other, node, want))
                    on_combo, node, want = not on_combo, other, here if want == colour else colour
                for c, g, k in chain:
                    del at_combo[c][k], at_group[g][k]
                for c, g, k in chain:
                    swapped = here if k == colour else colour
                    at_combo[c][swapped], at_group[g][swapped] = g, c
            at_combo[combo][colour], at_group[group][colour] = group, combo
    if any(max(used, default=-1) >= colours for used in at_combo):
        raise SplitError("paths do not close")
    return sorted((c, g, colour) for c, used in enumerate(at_combo) for colour, g in used.items())


def paths(spark: SparkSession, choices: list[tuple[int, ...]], n_groups: int) -> DataFrame:
    return spark.createDataFrame(path_table(choices, n_groups), "fold long, group long, path long")
