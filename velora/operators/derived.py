"""Columns that follow from others, each made once and only where it is asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

#: A frame with a column more, from a frame that has what the rule needs.
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rule:
    """One way to make a column: from the columns it needs, by an expression or by a step on the frame."""

    name: str
    needs: tuple[str, ...]
    make: Column | Step


@dataclass
class Derived:
    """Rules by name; of several for one name the first that can be met is taken, so that two forms may each be made from the other."""

    rules: dict[str, list[Rule]] = field(default_factory=dict)

    def add(self, name: str, needs: list[str], make: Column | Step) -> Derived:
        self.rules.setdefault(name, []).append(Rule(name, tuple(needs), make))
        return self

    def plan(self, has: list[str], wanted: list[str]) -> list[Rule]:
        """Rules in the order in which they have to run, each once; a ValueError names what can't be made."""
        done, order = set(has), []

        def reach(name: str, above: frozenset[str], done: set[str], order: list[Rule]) -> bool:
            if name in done:
                return True
            if name in above:  # needs itself
                return False
            for rule in self.rules.get(name, []):
                now, steps = set(done), list(order)
                if all(reach(n, above | {name}, now, steps) for n in rule.needs):
                    done |= now | {name}
                    order[:] = [*steps, rule]
                    return True
            return False

        missing = [w for w in wanted if not reach(w, frozenset(), done, order)]
        if missing:
            raise ValueError(f"no way to {missing} from {sorted(has)}")
        return order

    def derive(self, df: DataFrame, wanted: list[str]) -> DataFrame:
        """df's columns and the wanted ones, in that order; what was made on the way goes."""
        kept = list(df.columns)
        for rule in self.plan(kept, wanted):
            before = df.columns
            df = df.withColumn(rule.name, rule.make) if isinstance(rule.make, Column) else rule.make(df)
            gone = {*before, rule.name} - set(df.columns)
            if gone:
                raise ValueError(f"the step for {rule.name!r} lost {sorted(gone)}")
        return df.select(*[f"`{c}`" for c in [*kept, *(w for w in dict.fromkeys(wanted) if w not in kept)]])


def beside(step: Callable[..., DataFrame], column: str, keys: tuple[str, ...] = ("clip", "frame"), **how: str) -> Step:
    """An operator that gives (keys, column) as a step that keeps all other columns: its rows are joined by the keys."""

    def run(df: DataFrame) -> DataFrame:
        made = step(df, **how).select(*[df_key for df_key in keys], column)
        names = {k: f"_made_{k}" for k in keys}
        made = made.withColumnsRenamed(names)
        on = None
        for k, n in names.items():
            same = df[k].eqNullSafe(made[n])
            on = same if on is None else on & same
        return df.join(made, on).drop(*names.values())

    return run
