"""Word alignment of an expected text and a transcript.

The alignment is a cheapest one, every substitution, deletion and insertion costing one; of
these it has the most matches, so that the four counts do not depend on the way it is found.
There is one way, for texts of every length: rows of the edit table, within a band of
diagonals that the cost shows to be wide enough, so that work is length times errors. Counts
need one row at a time and follow from the last cell. For the path the expected words are
halved where the rows from both ends first meet at the least cost, until ``FEW`` words are
left, whose rows are walked back, pairs before deletions before insertions.

Where bounds already prove a cost the table is not filled: texts of one length whose words
agree at as many places as they have words in common differ by substitutions alone, and a
text whose words are all in the other one, in order, by deletions or insertions alone. The
first has one path; in the second a scan finds the same halves and pairs as the rows would.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATION = {"op": "string", "expected": "string", "actual": "string",
             "expected_index": "int", "actual_index": "int"}
FEW = 48
OPERATIONS = ("match", "substitution", "deletion", "insertion")
#: Operations in an output batch, whatever number of texts they are of.
BATCH_OPERATIONS = 1 << 17


def _rows(left: np.ndarray, right: np.ndarray, low: int, high: int, one: int
          ) -> Iterator[np.ndarray]:
    """The rows of the edit table on diagonals (right - left index) from low to high.

    A cell is errors times ``one`` less matches; cells off the band are out of reach.
    """
    far = np.int64(one) * (len(left) + len(right) + 2)
    width = high - low + 1
    columns = np.arange(low, high + 1)
    row = np.where((columns >= 0) & (columns <= len(right)), columns * one, far)
    ramp = np.arange(width, dtype=np.int64) * one
    inner = np.concatenate([np.full(max(0, -low), -1), right, np.full(
        max(0, len(left) + high - len(right)), -1)])
    shift = max(0, -low)
    yield row
    for i, word in enumerate(left):
        start = i + low + shift  # of the cell's word of the right text, in ``inner``
        same = inner[start:start + width] == word
        best = np.minimum(row + np.where(same, -1, one), np.append(row[1:], far) + one)
        first = -(i + 1 + low)  # the cell of column 0
        if 0 <= first < width:
            best[:first], best[first] = far, (i + 1) * one
        elif first >= width:
            best[:] = far
        row = np.minimum.accumulate(best - ramp) + ramp
        over = len(right) - (i + 1 + low) + 1  # cells beyond the right text
        if over < width:
            row[max(over, 0):] = far
        yield row


def _last_row(left: np.ndarray, right: np.ndarray, low: int, high: int, one: int) -> np.ndarray:
    for row in _rows(left, right, low, high, one):
        last = row
    return last


def _latest(short: list[int], long: list[int]) -> list[int] | None:
    """The place of each word of ``short`` in ``long``, as late as the order allows."""
    places, at = [], len(long)
    for word in reversed(short):
        at -= 1
        while at >= 0 and long[at] != word:
            at -= 1
        if at < 0:
            return None
        places.append(at)
    return places[::-1]


def _matches_of_one_kind(left: np.ndarray, right: np.ndarray) -> int | None:
    """Matches of texts that substitutions alone, or deletions or insertions alone, make equal.

    No alignment has more matches than there are words in common, nor fewer errors than the
    longer text has words besides; None if these bounds are not seen to be reached.
    """
    n, m = len(left), len(right)
    size = max(int(part.max(initial=0)) for part in (left, right)) + 1
    common = int(np.minimum(np.bincount(left, minlength=size),
                            np.bincount(right, minlength=size)).sum())
    if n == m:
        return common if common == np.count_nonzero(left == right) else None
    short, long = (left, right) if n < m else (right, left)
    if common < len(short):
        return None
    rest = iter(long.tolist())
    return common if all(word in rest for word in short.tolist()) else None


def _cost(left: np.ndarray, right: np.ndarray) -> int:
    """Least errors times (words + 1) less the most matches that these allow."""
    n, m = len(left), len(right)
    one, shift, spare = n + m + 1, abs(n - m), 8
    matches = _matches_of_one_kind(left, right)
    if matches is not None:
        return (max(n, m) - matches) * one - matches
    while True:
        low, high = min(0, m - n) - spare, max(0, m - n) + spare
        value = int(_last_row(left, right, low, high, one)[m - n - low])
        errors = -(-value // one)
        if errors <= shift + 2 * spare + 1:  # paths off the band cost more
            return value
        spare = max((errors - shift) // 2, 2 * spare)


def _ends(left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """The lengths of the equal head and tail."""
    shared = min(len(left), len(right))
    same = left[:shared] == right[:shared]
    head = shared if same.all() else int(same.argmin())
    rest = shared - head
    same = left[len(left) - rest:][::-1] == right[len(right) - rest:][::-1]
    return head, rest if same.all() else int(same.argmin())


def _walked_back(left: np.ndarray, right: np.ndarray, low: int, high: int, one: int
                 ) -> list[tuple[int, int]]:
    rows = list(_rows(left, right, low, high, one))
    i, j, found = len(left), len(right), []
    while i and j:
        value, k = rows[i][j - i - low], j - i - low
        if value == rows[i - 1][k] + (-1 if left[i - 1] == right[j - 1] else one):
            i, j = i - 1, j - 1
            found.append((i, j))
        elif k + 1 < len(rows[i]) and value == rows[i - 1][k + 1] + one:
            i -= 1
        else:
            j -= 1
    return found


def _pairs(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of indices that the alignment matches or substitutes."""
    one = len(left) + len(right) + 1
    found = []
    words = left.tolist(), right.tolist()
    work = [(0, len(left), 0, len(right), _cost(left, right))]
    while work:
        a, b, c, d, value = work.pop()
        errors = -(-value // one)
        head, tail = _ends(left[a:b], right[c:d])
        found += [(a + k, c + k) for k in range(head)]
        found += [(b - k, d - k) for k in range(tail, 0, -1)]
        a, b, c, d = a + head, b - tail, c + head, d - tail
        n, m = b - a, d - c
        if n == 0 or m == 0:
            continue
        if n == m and errors * one - value - head - tail == n - errors:  # the diagonal alone
            found += [(a + k, c + k) for k in range(n)]
            continue
        if errors == abs(n - m):  # the shorter text is within the longer one
            short, long = words[0][a:b], words[1][c:d]
            if n > m:
                short, long = long, short
            middle = n // 2
            if n <= FEW:
                places = enumerate(_latest(short, long))
                found += [(a + j, c + i) if n > m else (a + i, c + j) for i, j in places]
                continue
            if n > m:
                cut = bisect_left(_latest(short, long), middle)
            else:
                rest = iter(enumerate(long, 1))
                cut = 0
                for word in short[:middle]:
                    cut = next(k for k, other in rest if other == word)
            first = abs(middle - cut) * one - min(middle, cut)
            last = abs(n - middle - m + cut) * one - min(n - middle, m - cut)
            work += [(a, a + middle, c, c + cut, first), (a + middle, b, c + cut, d, last)]
            continue
        spare = (errors - abs(n - m)) // 2
        low, high = min(0, m - n) - spare, max(0, m - n) + spare
        if n <= FEW:
            found += [(a + i, c + j) for i, j in _walked_back(
                left[a:b], right[c:d], low, high, one)]
            continue
        middle = n // 2
        down = _last_row(left[a:a + middle], right[c:d], low, high, one)
        up = _last_row(left[a + middle:b][::-1], right[c:d][::-1], m - n - high, m - n - low,
                       one)[::-1]
        best = int(np.argmin(down + up))
        cut = c + middle + low + best
        work += [(a, a + middle, c, cut, int(down[best])), (a + middle, b, cut, d, int(up[best]))]
    return sorted(found)


def _codes(expected: list[str], actual: list[str]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Words as numbers and the lengths of the equal head and tail."""
    known = {word: k for k, word in enumerate(dict.fromkeys([*expected, *actual]))}
    left, right = (np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                   for words in (expected, actual))
    return left, right, *_ends(left, right)


def count_edits(expected: list[str], actual: list[str]) -> tuple[int, int, int, int]:
    """Matches, substitutions, deletions, insertions."""
    left, right, head, tail = _codes(expected, actual)
    a, b = left[head:len(left) - tail], right[head:len(right) - tail]
    value, one = _cost(a, b), len(a) + len(b) + 1
    errors = -(-value // one)
    matches = errors * one - value
    added = matches - len(a) + errors
    dropped = added + len(a) - len(b)
    return head + tail + matches, errors - added - dropped, dropped, added


def _steps(expected: list[str], actual: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Operations as numbers in ``OPERATIONS`` and both indices, -1 for none."""
    left, right, head, tail = _codes(expected, actual)
    n, m = len(left), len(right)
    middle = _pairs(left[head:n - tail], right[head:m - tail])
    pairs = np.concatenate([
        np.repeat(np.arange(head)[:, None], 2, axis=1),
        np.array(middle, dtype=np.int64).reshape(-1, 2) + head,
        np.arange(-tail, 0)[:, None] + (n, m)]).astype(np.int64)
    a, b = pairs.T
    count = len(a)
    ops = np.empty(n + m - count, dtype=np.int8)
    first, second = (np.full(len(ops), -1, dtype=np.int32) for _ in range(2))
    place = a + b - np.arange(count)
    ops[place], first[place], second[place] = left[a] != right[b], a, b
    # What is between two pairs: deletions, then insertions.
    lost, added = np.delete(np.arange(n), a), np.delete(np.arange(m), b)
    gap = np.searchsorted(a, lost)
    place = lost + np.concatenate([[0], b + 1])[gap] - gap
    ops[place], first[place] = 2, lost
    gap = np.searchsorted(b, added)
    place = added + np.concatenate([a, [n]])[gap] - gap
    ops[place], second[place] = 3, added
    return ops, first, second


def align_words(expected: list[str], actual: list[str]) -> list[dict]:
    """Operations match, substitution, deletion and insertion with both indices."""
    return [{"op": OPERATIONS[op], "expected": None if a < 0 else expected[a],
             "actual": None if b < 0 else actual[b],
             "expected_index": None if a < 0 else a, "actual_index": None if b < 0 else b}
            for op, a, b in zip(*(part.tolist() for part in _steps(expected, actual)))]


def align(frame: DataFrame, expected: str, actual: str,
          operations: tuple[str, ...] = OPERATIONS,
          fields: tuple[str, ...] = tuple(OPERATION)) -> DataFrame:
    """Add ``alignment``: the operations between two columns of compared words.

    Only those named in ``operations`` are kept, and only ``fields`` of them. Batches are cut by the number of operations,
    so that a task's memory does not follow the lengths of its texts.
    """
    wanted = np.isin(OPERATIONS, operations)

    def column(rows: list[tuple]) -> pa.Array:
        left, right, steps = zip(*rows)
        ops, *sides = (np.concatenate(part) for part in zip(*steps))
        sizes = [len(step[0]) for step in steps]

        def values(name: str) -> pa.Array:
            if name == "op":
                return pa.array(OPERATIONS, pa.string()).take(pa.array(ops))
            texts, index = (left, sides[0]) if name.startswith("e") else (right, sides[1])
            if name.endswith("_index"):
                return pa.array(index, pa.int32(), mask=index < 0)
            begin = np.repeat(np.cumsum([0, *map(len, texts[:-1])]), sizes)
            words = pa.array([word for text in texts for word in text], pa.string())
            return words.take(pa.array(index + begin, mask=index < 0))

        return pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *sizes]), pa.int32()),
            pa.StructArray.from_arrays([values(name) for name in fields], list(fields)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, held = [], 0, 0
            for number, texts in enumerate(zip(batch.column(expected), batch.column(actual)), 1):
                left, right = ((text.as_py() or "").split() for text in texts)
                steps = _steps(left, right)
                kept = wanted[steps[0]]
                rows.append((left, right, [part[kept] for part in steps]))
                held += len(left) + len(right)
                if held > BATCH_OPERATIONS or number == batch.num_rows:
                    part = batch.slice(start, number - start)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, column(rows)], [*part.schema.names, "alignment"])
                    rows, start, held = [], number, 0

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]
    step = ",".join(f"{name}:{OPERATION[name]}" for name in fields)
    return frame.mapInArrow(add, ", ".join([*columns, f"alignment array<struct<{step}>>"]))


def edit_counts(frame: DataFrame, expected: str, actual: str) -> DataFrame:
    """Add ``matches``, ``substitutions``, ``deletions`` and ``insertions``.

    Equal texts need no alignment: they are counted in the JVM and only their
    key columns and counts pass on; texts leave the JVM for the others alone.
    """
    same = F.col(expected) == F.col(actual)
    kept = [c for c in frame.columns if c not in (expected, actual)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tallies = [
                (words, 0, 0, 0) if left is None else count_edits(left.split(), right.split())
                for left, right, words in zip(batch["_left"], batch["_right"], batch["_words"])]
            counts = pd.DataFrame(
                tallies, columns=["matches", "substitutions", "deletions", "insertions"])
            yield pd.concat([batch[kept].reset_index(drop=True), counts], axis=1)

    def words(name: str) -> Column:
        return F.size(F.filter(F.split(F.col(name), " "), lambda w: w != ""))

    narrow = frame.select(
        *kept, F.when(~same, F.col(expected)).alias("_left"),
        F.when(~same, F.col(actual)).alias("_right"), words(expected).alias("_words"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in frame.select(*kept).schema.fields)
    return narrow.mapInPandas(
        count, f"{fields}, matches int, substitutions int, deletions int, insertions int")


def error_rate(errors: Column, words: Column) -> Column:
    """(S + D + I) / max(N, 1)."""
    return errors / F.greatest(words, F.lit(1))


def error_threshold(words: Column, tolerance: str) -> Column:
    """Errors that a text of this length may have."""
    tenth = F.ceil(words / 10)
    return {
        "LOW": tenth + 1,
        "MODERATE": tenth,
        "HIGH": F.greatest(F.lit(0), tenth - 1),
        "INTOLERANT": F.lit(0).cast("long"),
    }[tolerance]
