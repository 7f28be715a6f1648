"""Functions of arrays. Indices count from 0; what is absent is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evseq.functions.codes import col


def truncate(a, n) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(col(a), F.lit(1), F.greatest(n, F.lit(0)))


def truncate_with(a, n: int, last: str) -> Column:
    return F.concat(F.slice(col(a), 1, n - 1), F.array(F.lit(last)))


def last_index(a, token) -> Column:
    at = F.array_position(F.reverse(col(a)), token)
    return F.when(at > 0, (F.size(col(a)) - at).cast("int"))


def first_index_where(a, test: Callable[[Column, Column], Column]) -> Column:
    return F.array_min(F.filter(F.transform(col(a), lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()))


def positions(a) -> Column:
    return F.transform(col(a), lambda x, i: i)


def count_of(a, token) -> Column:
    return F.size(F.filter(col(a), lambda x: x == token))


def wide(a, names: list[str], missing: int = -1) -> list[Column]:
    return [F.coalesce(F.get(col(a), i), F.lit(missing)).cast("int").alias(n) for i, n in enumerate(names)]


def flat(a) -> Column:
    """[[1, 2]] as [1, 2]."""
    return F.when(F.size(col(a)) == 1, F.get(col(a), 0)).otherwise(F.flatten(col(a)))


def listed(c) -> Column:
    """A scalar as a list of one, null as an empty list."""
    return F.filter(F.array(col(c)), lambda x: x.isNotNull())


def pad(a, n: int, value, side: str = "right") -> Column:
    kept = truncate(a, n)
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), n - F.size(kept))
    return F.concat(kept, fill) if side == "right" else F.concat(fill, kept)


def mask(a, n: int, side: str = "right") -> Column:
    return pad(F.transform(truncate(a, n), lambda x: F.lit(1)), n, 0, side)


def cut(a, cutoff) -> Column:
    """What stands before the cutoff; null and -1 cut nothing."""
    c = col(cutoff)
    return F.when(c.isNull() | (c < 0), col(a)).otherwise(truncate(a, c))


def with_ends(a, first=None, last=None) -> Column:
    out = col(a)
    if first is not None:
        out = F.when(F.size(out) > 0, F.concat(F.array(F.lit(first)), F.slice(out, F.lit(2), F.greatest(F.size(out) - 1, F.lit(0))))).otherwise(out)
    if last is not None:
        out = F.when(F.size(out) > 0, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.lit(last)))).otherwise(out)
    return out


def clip(a, low, high) -> Column:
    return F.transform(col(a), lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def or_default(a, value, n: int) -> Column:
    return F.coalesce(col(a), F.array_repeat(F.lit(value), n))


def pad_start(a, pad_id=0) -> Column:
    """Where padding begins; the size if there is none."""
    at = F.array_position(col(a), F.lit(pad_id))
    return F.when(at > 0, at - 1).otherwise(F.size(col(a))).cast("int")


def extend(a, n: int) -> Column:
    return F.when(F.size(col(a)) > 0, F.concat(col(a), F.array_repeat(F.try_element_at(col(a), F.lit(-1)), n))).otherwise(col(a))


def min_positive(a) -> Column:
    return F.coalesce(F.array_min(F.filter(col(a), lambda x: x > 0)), F.lit(0))


def uniform(seed: str, *parts: Column) -> Column:
    """A number from 0 to 1 that depends on seed and parts alone, from md5, so that other engines agree."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mlm(ids, row_id, mask_id: int, vocab_size: int, seed: str = "mlm", rate: float = 0.15) -> tuple[Column, Column]:
    """Masked ids and labels. Ids above mask_id are chosen at `rate`; of those 80 % become the mask, then a tenth of the rest a
    random id above mask_id (never the last); labels are -100 elsewhere."""
    u = lambda kind, i: uniform(seed, F.lit(kind), col(row_id).cast("string"), i.cast("string"))
    chosen = lambda x, i: (x > mask_id) & (u("pick", i) < rate)
    spare = vocab_size - 1 - (mask_id + 1)
    other = lambda i: (F.lit(mask_id + 1) + F.floor(u("other", i) * spare)).cast("int")
    masked = F.transform(col(ids), lambda x, i: F.when(chosen(x, i) & (u("mask", i) < 0.8), F.lit(mask_id)).when(chosen(x, i) & (u("swap", i) < 0.1), other(i)).otherwise(x).cast("int"))
    labels = F.transform(col(ids), lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(-100)).cast("int"))
    return masked, labels


def with_task(a, token: str, encoder: bool = True) -> Column:
    """The task's token in place of the first element, and of the last for decoders."""
    return with_ends(a, first=token) if encoder else with_ends(a, first=token, last=token)
