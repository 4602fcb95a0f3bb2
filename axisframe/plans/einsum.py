"""Order of pairwise contractions of an einsum, and their lowering to joins and groupings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import functions as F

from ..dtypes import promote, wider_sum
from ..frame import BROADCAST_ELEMENTS, NDFrame
from ..functions import complexes as C


def parse(subscripts: str, ndims: Sequence[int]) -> tuple[list[str], str]:
    """Labels of every operand and of the result, an ellipsis spelled out in capital letters."""
    text = subscripts.replace(" ", "")
    left, arrow, out = text.partition("->")
    operands = left.split(",")
    if len(operands) != len(ndims):
        raise ValueError(f"{len(operands)} terms for {len(ndims)} operands")
    free = [c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in text]
    extra = max((n - len(t.replace("...", "")) for t, n in zip(operands, ndims) if "..." in t), default=0)
    names = "".join(free[:extra])
    terms = []
    for t, n in zip(operands, ndims):
        own = n - len(t.replace("...", ""))
        terms.append(t.replace("...", names[extra - own :] if own else ""))
        if len(terms[-1]) != n:
            raise ValueError(f"{t!r} doesn't name {n} axes")
    labels = "".join(terms)
    if not arrow:
        out = names + "".join(sorted(c for c in set(labels) - set(names) if labels.count(c) == 1))
    out = out.replace("...", names)
    if len(set(out)) < len(out) or not set(out) <= set(labels):
        raise ValueError(f"{out!r} isn't a choice of the operands' labels")
    return terms, out


def sizes(terms: Sequence[str], shapes: Sequence[Sequence[int]]) -> dict[str, int]:
    found: dict[str, int] = {}
    for t, shape in zip(terms, shapes):
        for c, n in zip(t, shape):
            if found.get(c, 1) != n and n != 1 and found.get(c, 1) != 1:
                raise ValueError(f"axis {c!r} has sizes {found[c]} and {n}")
            found[c] = max(found.get(c, 1), n)
    return found


def _merged(a: str, b: str, rest: Sequence[str], out: str) -> str:
    needed = set(out).union(*rest) if rest else set(out)
    return "".join(c for c in dict.fromkeys(a + b) if c in needed)


def path(terms: Sequence[str], out: str, size: dict[str, int], how: str = "greedy") -> list[tuple[int, int]]:
    """Pairs of operand numbers; a pair is taken out and its product put at the end."""
    cost = lambda labels: math.prod(size[c] for c in set(labels))
    if how == "left":
        return [(0, 1) if k == 0 else (0, len(terms) - k - 1) for k in range(len(terms) - 1)]
    if how == "optimal" and len(terms) <= 6:
        best: dict = {}

        def search(now: tuple[str, ...]) -> tuple[float, list]:
            if len(now) < 2:
                return 0, []
            if now not in best:
                options = []
                for i, j in itertools.combinations(range(len(now)), 2):
                    rest = [t for k, t in enumerate(now) if k not in (i, j)]
                    more, steps = search((*rest, _merged(now[i], now[j], rest, out)))
                    options.append((cost(now[i] + now[j]) + more, [(i, j), *steps]))
                best[now] = min(options, key=lambda x: x[0])
            return best[now]

        return search(tuple(terms))[1]
    now, steps = list(terms), []
    while len(now) > 1:

        def worth(pair):
            rest = [t for k, t in enumerate(now) if k not in pair]
            result = _merged(now[pair[0]], now[pair[1]], rest, out)
            return cost(result) - cost(now[pair[0]]) - cost(now[pair[1]]), cost(now[pair[0]] + now[pair[1]])

        i, j = min(itertools.combinations(range(len(now)), 2), key=worth)
        rest = [t for k, t in enumerate(now) if k not in (i, j)]
        steps.append((i, j))
        now = [*rest, _merged(now[i], now[j], rest, out)]
    return steps


def _labelled(x: NDFrame, labels: str):
    """A DataFrame with one column a label; a label that is there twice takes the diagonal."""
    df, names = x.df, {}
    for k, c in enumerate(labels):
        if c in names:
            df = df.filter(F.col(names[c]) == F.col(f"i{k}"))
        else:
            names[c] = f"i{k}"
    return df.select(*(F.col(i).alias(c) for c, i in names.items()), "v")


def einsum(subscripts: str, *operands: NDFrame, optimize: str = "greedy") -> NDFrame:
    """Sums of products over labels: shared labels are join keys, labels that go are summed by the grouping."""
    terms, out = parse(subscripts, [x.ndim for x in operands])
    size = sizes(terms, [x.shape for x in operands])
    kind = promote(*(x.dtype for x in operands))
    if kind.kind == "c":
        times, total = C.multiply, lambda v: F.struct(F.sum(v["re"]).alias("re"), F.sum(v["im"]).alias("im"))
    else:
        times, total = (lambda a, b: (a * b).cast(kind.spark)), (lambda v: F.sum(v).cast(kind.spark))
    kind = wider_sum(kind) if kind.kind in "biu" else kind
    parts = []
    for x, t in zip(operands, terms):
        own = x.astype(kind)
        if any(n == 1 != size[c] for n, c in zip(x.shape, t)):
            own = own.broadcast_to([size[c] for c in t])
        parts.append((_labelled(own, t), "".join(dict.fromkeys(t)), x.size))
    for i, j in path([p[1] for p in parts], out, size, optimize):
        (b, lb, nb), (a, la, na) = parts.pop(j), parts.pop(i)
        shared = [c for c in la if c in lb]
        b = b.withColumnRenamed("v", "w")
        if shared:
            both = a.join(F.broadcast(b) if nb <= BROADCAST_ELEMENTS else b, shared)
        elif min(na, nb) <= BROADCAST_ELEMENTS:
            both = a.crossJoin(F.broadcast(b)) if nb <= na else F.broadcast(a).crossJoin(b)
        else:
            raise ValueError("an outer product of two large arrays isn't materialised")
        kept = _merged(la, lb, [p[1] for p in parts], out)
        product = both.select(*kept, times(F.col("v"), F.col("w")).alias("v"))
        if set(la + lb) - set(kept):
            product = product.groupBy(*kept).agg(total(F.col("v")).alias("v"))
        parts.append((product, kept, math.prod(size[c] for c in kept)))
    df, labels, _ = parts[0]
    if set(labels) != set(out) or len(operands) == 1:
        df = df.groupBy(*out).agg(total(F.col("v")).alias("v"))
    return NDFrame(df.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(out)), "v"), [size[c] for c in out], kind)


def einsum_path(subscripts: str, *shapes: Sequence[int], how: str = "greedy") -> list[tuple[int, int]]:
    terms, out = parse(subscripts, [len(s) for s in shapes])
    return path(terms, out, sizes(terms, shapes), how)
