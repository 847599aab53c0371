"""Array functions on stored token sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from banlist.functions.fixed_values import STOP_MARKERS


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_prompt(ids: Column | str, prompt_ids: Column | str) -> Column:
    """The ids that follow the prompt's ids."""
    ids, prompt_ids = _col(ids), _col(prompt_ids)
    return F.slice(ids, F.size(prompt_ids) + 1, F.size(ids))


def drop_banned(tokens: Column | str, banned: Sequence[str]) -> Column:
    """The tokens left when every banned one is removed.

    A null array stays null and a null element stays. Meant for lists that fit a literal (a hash set at run time); see
    ``operators.scrub`` for lists held in a table.
    """
    banned = list(banned)
    if not banned:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: F.coalesce(~t.isin(banned), F.lit(True)))


def first_marker_position(tokens: Column | str, markers: Sequence[str] = STOP_MARKERS) -> Column:
    """1-based place of the first stop marker; the array size if there is none."""
    tokens = _col(tokens)
    places = F.array(*[F.array_position(tokens, F.lit(m)) for m in markers])
    found = F.array_min(F.filter(places, lambda p: p > 0))
    return F.coalesce(found.cast("int"), F.size(tokens))


def drop_banned_until_marker(
    tokens: Column | str, banned: Sequence[str], markers: Sequence[str] = STOP_MARKERS
) -> Column:
    """Remove banned tokens up to and including the first stop marker only."""
    tokens = _col(tokens)
    cut = first_marker_position(tokens, markers)
    return F.concat(
        drop_banned(F.slice(tokens, F.lit(1), cut), banned),
        F.slice(tokens, cut + 1, F.size(tokens)),
    )


def ends_on_marker(tokens: Column | str, markers: Sequence[str] = STOP_MARKERS) -> Column:
    last = F.try_element_at(_col(tokens), F.lit(-1))
    return F.coalesce(last.isin(list(markers)), F.lit(False))
