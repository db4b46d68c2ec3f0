"""Best-fit packing of token pieces into sequences by a configuration linear program over the length histogram.

Only the histogram of lengths (at most max_tokens numbers, whatever the corpus) comes to the driver. There:

1. Pieces of full length are sequences. Of the others, the shortest, SMALL_SHARE of the volume at most, are set
   aside for gaps, and the rest is grouped by length: N_GROUPS groups of about equal volume, or a group a length.
2. The covering program "fewest sequences, every group covered" is a game of configurations against groups. It is
   solved by multiplicative weights: the configuration that earns most by the groups' weights is played, and what
   it covers loses weight. Now and then a knapsack by dynamic programming over the sequence length prices the mean
   weights and brings the best configuration through each group into the pool.
3. The solution is rounded: each configuration is used as often as its whole part says, then once for what is
   left of it, with actual lengths of its groups, the last two of which are chosen to fill the sequence. What
   would leave more room than the lower bound spares is put off: the program is solved anew for the rest, until
   REST_SHARE of the volume is left.
4. That rest and the pieces set aside go to further sequences, the longest piece that fits first (best fit).

The plan is a table whose size depends on max_tokens alone; pieces, numbered within their length, look up their
sequence and place there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, map_rows, numbered_chunks, stored, with_slots
from weftline.llm.tokens import MAX_TOKENS, vocabulary, vocabulary_path

Plan = list[tuple[dict[int, int], int]]

N_GROUPS = 256
#: Pieces set aside are shorter than this part of a sequence, and have this share of the volume at most.
SMALL_PART, SMALL_SHARE = 1 / 16, 0.02
#: Share of the volume that may be left to best fit, and solutions of the program at most.
REST_SHARE, MOST_PASSES = 0.05, 8


def knapsacks(sizes: np.ndarray, need: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(configurations as counts of each size, their worth): for each size, the best one that holds it.

    A size is in a configuration at most as often as it is needed: its copies are items of 1, 2, 4, ... of it.
    best_before[i] and best_after[i] have the worth of the items before i, and from i on, for each room.
    """
    which, copies = [], []
    for i, (s, n) in enumerate(zip(sizes.tolist(), need.tolist())):
        left, k = min(int(n), capacity // s), 1
        while left > 0:
            which.append(i)
            copies.append(min(k, left))
            left, k = left - copies[-1], 2 * k
    which, copies = np.array(which), np.array(copies)
    n, room = len(which), (sizes[which] * copies).tolist()
    gain = (worth[which] * copies).tolist()
    before, after = np.zeros((n + 1, capacity + 1)), np.zeros((n + 1, capacity + 1))
    for i in range(n):
        before[i + 1] = before[i]
        np.maximum(before[i][room[i] :], before[i][: capacity + 1 - room[i]] + gain[i], out=before[i + 1][room[i] :])
    for i in range(n - 1, -1, -1):
        after[i] = after[i + 1]
        np.maximum(after[i + 1][room[i] :], after[i + 1][: capacity + 1 - room[i]] + gain[i], out=after[i][room[i] :])
    to_before, total = np.empty(n, np.int64), np.empty(n)
    for i in range(n):
        rest = capacity - room[i]
        both = before[i][: rest + 1] + after[i + 1][rest::-1]
        to_before[i] = k = int(both.argmax())
        total[i] = both[k] + gain[i]
    counts = np.zeros((n, len(sizes)), np.int64)
    counts[np.arange(n), which] += copies
    to_after = capacity - np.array(room) - to_before
    for i in range(n - 1, -1, -1):  # the configurations through later items take item i, or don't
        c = to_before[i + 1 :]
        took = np.flatnonzero(before[i + 1][c] > before[i][c]) + i + 1
        counts[took, which[i]] += copies[i]
        to_before[took] -= room[i]
    for i in range(n):
        c = to_after[:i]
        took = np.flatnonzero(after[i][c] > after[i + 1][c])
        counts[took, which[i]] += copies[i]
        to_after[took] -= room[i]
    return counts, total


def groups_of(histogram: np.ndarray, n_groups: int) -> list[np.ndarray]:
    """Lengths that occur, ascending, cut into groups of about equal volume."""
    lengths = np.flatnonzero(histogram)
    volume = np.cumsum(lengths * histogram[lengths])
    part = np.minimum((volume - 1) * n_groups // max(1, int(volume[-1])), n_groups - 1) if len(volume) else volume
    return [lengths[part == k] for k in np.unique(part)]


def cover(configs: list[tuple[tuple[int, ...], tuple[int, ...]]], need: np.ndarray, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(how often each configuration is played, mean weights of the groups) by multiplicative weights.

    configs: the groups of each, ascending, and how often each is in it. The configuration that earns most by the
    weights is played until it covers as much of some group as a round may, so that no payoff outweighs the rest,
    and each group's weight falls exponentially with what is covered. A play changes the weights of a few groups,
    so that the earnings of the configurations with those alone are brought up to date.
    """
    group = np.concatenate([c[0] for c in configs]).astype(np.int64)
    ends = np.cumsum([0, *(len(c[0]) for c in configs)])
    pay = np.concatenate([c[1] for c in configs]) / need[group]
    most = np.maximum.reduceat(pay, ends[:-1])
    owner = np.repeat(np.arange(len(configs)), np.diff(ends))
    by_group = np.argsort(group, kind="stable")
    of_group = np.searchsorted(group[by_group], np.arange(len(need) + 1)).tolist()
    group_owner, group_pay = owner[by_group], pay[by_group]
    log_weight = np.zeros(len(need))
    played, mean = np.zeros(len(configs)), np.zeros(len(need))
    every = 200
    for r in range(rounds):
        if r % every == 0:
            log_weight -= log_weight.max()
            weight = np.exp(log_weight)
            earns = np.add.reduceat(pay * weight[group], ends[:-1])
            mean += weight / weight.sum()
        k = int(earns.argmax())
        played[k] += 1 / most[k]
        a, b = ends[k], ends[k + 1]
        log_weight[group[a:b]] -= rate * pay[a:b] / most[k]
        for g in group[a:b].tolist():
            new = np.exp(log_weight[g])
            x, y = of_group[g], of_group[g + 1]
            earns[group_owner[x:y]] += group_pay[x:y] * (new - weight[g])
            weight[g] = new
    return played, mean / mean.sum()


def solve(sizes: np.ndarray, need: np.ndarray, capacity: int, pricings: int = 24) -> list[tuple[dict[int, int], float]]:
    """(configuration, how often) of the covering program over groups, scaled until every group is covered."""
    need = need.astype(float)
    pool: dict[tuple[tuple[int, ...], tuple[int, ...]], None] = {}
    weights = sizes * need / (sizes @ need)  # by volume at first
    rounds = 6 * len(sizes) + 200
    for last in [False] * (pricings - 1) + [True]:
        counts, total = knapsacks(sizes, need, weights / need, capacity)
        for c in counts[total >= 0.9 * total.max()]:
            at = np.flatnonzero(c)
            pool.setdefault((tuple(at.tolist()), tuple(c[at].tolist())))
        configs = list(pool)
        played, weights = cover(configs, need, 4 * rounds if last else rounds, 0.1 if last else 0.3)
    held = np.zeros(len(sizes))
    for (at, n), x in zip(configs, played):
        held[list(at)] += x * np.array(n)
    short = (held / need).min()
    if short <= 0:  # a group that no play covered has a configuration in the pool
        short = 1.0
    return [(dict(zip(*c)), x / short) for c, x in zip(configs, played) if x > 0]


def fill(left: np.ndarray, capacity: int, config: dict[int, int] | None = None) -> dict[int, int]:
    """config and the longest lengths that still fit in it, again and again, of what is left."""
    config = dict(config or {})
    room = capacity - sum(s * k for s, k in config.items())
    lengths = np.flatnonzero(left)
    at = len(lengths)
    while room > 0:
        at = min(at, int(np.searchsorted(lengths, room, "right"))) - 1
        if at < 0:
            break
        s = int(lengths[at])
        k = min(room // s, int(left[s]) - config.get(s, 0))
        if k > 0:
            config[s] = config.get(s, 0) + k
            room -= s * k
    return config


def _use(left: np.ndarray, config: dict[int, int], most: int, out: Plan) -> int:
    """Puts config into the plan as often as what is left allows, at most so often; returns how often."""
    times = min(most, *(int(left[s]) // k for s, k in config.items()))
    for s, k in config.items():
        left[s] -= times * k
    out.append((config, times))
    return times


def with_lengths(parts: list[int], groups: list[np.ndarray], left: np.ndarray, capacity: int) -> dict[int, int] | None:
    """Actual lengths for the groups (longest first) of a configuration, or None if what is left has none that fit.

    Each group gives its longest length, but the last two those that leave the least room; the very last may come
    from two groups below its own or from any above it.
    """
    held: dict[int, int] = {}

    def longest(among: list[int], room: int) -> int | None:
        return next((s for s in among if s <= room and left[s] > held.get(s, 0)), None)

    room = capacity
    for g in parts[:-2]:
        s = longest(groups[g][::-1].tolist(), room)
        if s is None:
            return None
        held[s] = held.get(s, 0) + 1
        room -= s
    if len(parts) == 1:
        s = longest(groups[parts[0]][::-1].tolist(), room)
        return None if s is None else {s: 1}
    least = int(groups[max(0, parts[-1] - 2)][0])
    last = (np.flatnonzero(left[least : max(least, room + 1)]) + least)[::-1]
    best: tuple[int, int, int] | None = None
    for a in groups[parts[-2]][::-1].tolist():
        if left[a] <= held.get(a, 0) or room - a < least:
            continue
        held[a] = held.get(a, 0) + 1
        b = longest(last[np.searchsorted(-last, a - room) :].tolist(), room - a)
        held[a] -= 1
        if b is not None and (best is None or room - a - b < best[0]):
            best = (room - a - b, a, b)
            if not best[0]:
                break
    if best is None:
        return None
    for s in best[1:]:
        held[s] = held.get(s, 0) + 1
    return {s: k for s, k in held.items() if k}


def plan(histogram: np.ndarray, capacity: int, n_groups: int = N_GROUPS) -> tuple[Plan, int]:
    """(configurations, length to count, with whole multiplicities; how many of them the program gave).

    They hold exactly the histogram's pieces. Those of the program, and full pieces, come first; the rest is best fit.
    """
    left, lengths = histogram.astype(np.int64).copy(), np.arange(len(histogram))
    out: Plan = []
    volume = int(left @ lengths)
    if left[capacity]:
        _use(left, {capacity: 1}, int(left[capacity]), out)
    aside = np.cumsum(left * lengths) <= SMALL_SHARE * volume
    aside &= lengths < SMALL_PART * capacity
    spare = -volume % capacity / max(1, -(-volume // capacity))  # room a sequence, at the lower bound
    most_room = int(2 * spare)
    for _ in range(MOST_PASSES):
        large = np.where(aside, 0, left)
        if large @ lengths <= max(REST_SHARE * volume, 2 * capacity):
            break
        groups = groups_of(large, n_groups)
        need = np.array([left[g].sum() for g in groups])
        sizes = np.array([left[g] @ g // left[g].sum() for g in groups])
        solution = solve(sizes, need, capacity)
        used = 0
        whole = [(x, int(x), config) for config, x in solution]
        for times, config in (
            *((n, c) for _, n, c in sorted(whole, key=lambda w: -w[0])), *((1, c) for _, _, c in sorted(whole, key=lambda w: w[1] - w[0]))
        ):
            parts = [g for g in sorted(config, reverse=True) for _ in range(config[g])]
            while times > 0:
                held = with_lengths(parts, groups, left, capacity)
                if held is None or capacity - sum(s * k for s, k in held.items()) > most_room:
                    break
                n = _use(left, held, times, out)
                times, used = times - n, used + n
        if 2 * used < sum(x for _, x in solution):
            most_room = max(1, 8 * most_room)  # the lengths don't fill sequences so well
    of_program = len(out)
    while left.any():
        _use(left, fill(left, capacity), int(left.sum()), out)
    return out, of_program


def lookup(the_plan: Plan) -> np.ndarray:
    """Rows (length, first number, first sequence, count in a sequence, offset of the first), by length and number."""
    rows, taken, sequence = [], {}, 0
    for config, times in the_plan:
        offset = 0
        for s, k in sorted(config.items(), reverse=True):
            a = taken.get(s, 0)
            rows.append((s, a, sequence, k, offset))
            taken[s] = a + times * k
            offset += s * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placing(places: np.ndarray):
    """A column function of (length, number) that gives (sequence_id, offset): a search in lookup()'s rows."""
    starts = np.searchsorted(places[:, 0], np.arange(places[-1, 0] + 2)) if len(places) else np.zeros(1, np.int64)

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        s, n = length.to_numpy(), number.to_numpy()
        at = np.empty(len(s), np.int64)
        for one in np.unique(s).tolist():
            a, b = int(starts[one]), int(starts[one + 1])
            rows = np.flatnonzero(s == one)
            at[rows] = a + np.searchsorted(places[a:b, 1], n[rows], "right") - 1
        _, first, sequence, k, offset = places[at].T
        nth = n - first
        return pa.StructArray.from_arrays([pa.array(sequence + nth // k), pa.array(offset + s * (nth % k))], names=["sequence_id", "offset"])

    return place


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: ids of each text and the end id, cut where longer than capacity."""
    end = int(end_id).to_bytes(4, "little")

    def make():
        v = vocabulary(path)

        def work(part: pa.RecordBatch) -> dict:
            ids, out = part.column(0).to_pylist(), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, raw in zip(ids, v.id_bytes(part.column(1).to_pylist())):
                raw += end
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[a : a + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(a >> 2)
                    out["length"].append(len(cut) >> 2)
                    out["ids_crc32"].append(zlib.crc32(cut))
            return out

        return work

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = MAX_TOKENS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id alone. A longer document than capacity is cut into
    pieces of capacity, the last one shorter. Repeated rows and null ids are packed like others, each row for
    itself; an empty table gives no rows. Offsets are gapless from 0 in each sequence. The texts are read once;
    only the narrow table of pieces is shuffled.
    """
    cut = pieces(docs, path or vocabulary_path(), capacity, end_id, id_col, text_col)
    cut = stored(numbered_chunks(cut, "chunk"), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most capacity rows
        histogram[row["length"]] = row["count"]
    numbered = with_slots(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "number", "chunk")
    # the plan has a bounded number of rows: it depends on capacity alone
    place = placing(lookup(plan(histogram, capacity)[0]))
    placed = numbered.withColumn("place", place("length", "number"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
