"""Collects feature columns by the stage they are computed in.

All window columns of a matrix share one exchange and one sort: level 0 reads the
input, level 1 reads level 0, and so on.  Run-length features and the exponential mean
share one narrow pass for their carries; row features follow after the halo copies are
gone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.operators.blocks import BLK, POS, Series, carry_last, settle, spread
from gridtide.operators.windows import EWM_COLUMNS, Ewm, ewm

WindowColumn = Callable[[Series], Column]


class Matrix:
    def __init__(self, df: DataFrame, s: Series, back: int, ahead: int = 0, have: set[str] | None = None):
        self.df, self.s, self.back, self.ahead = df, s, back, ahead
        # Columns that hold values; without a count every present column is assumed to.
        self.have = set(df.columns) if have is None else have & set(df.columns)
        self.levels: list[dict[str, WindowColumn]] = []
        self.batches: list[dict[str, Column]] = []
        self.marks: dict[str, Column] = {}
        self.runs: dict[str, Callable[[Column, Column, Column], Column]] = {}
        self.dropped: list[str] = []
        self.decayed: dict[str, Ewm] = {}

    def has(self, *cols: str) -> bool:
        return all(c in self.have for c in cols)

    def window(self, level: int, **cols: WindowColumn) -> None:
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level].update(cols)

    def lag(self, name: str, c: str, n: int) -> None:
        self.window(0, **{name: lambda s: F.lag(c, n).over(s.over)})

    def run(self, name: str, mark: Column, value: Callable[[Column, Column, Column], Column]) -> None:
        """A feature of the last marked slot: ``value(slot, last marked slot, origin)``."""
        self.marks[f"_m_{name}"] = F.when(mark, F.col(POS))
        self.runs[name] = value

    def decayed_lag(self, name: str, c: str, span: int) -> None:
        """The exponential mean of ``c`` one slot back (one such feature a matrix); blocks
        too long for its sums have it made beforehand."""
        e = Ewm(self.s, F.when(F.col(BLK) == self.s.home, F.col(c)), span)
        if self.decayed or self.s.rows > e.most:
            self.df = ewm(self.df, self.s, c, f"_{name}", span)
            self.lag(name, f"_{name}", 1)
            self.drop(f"_{name}")
            return
        self.decayed[name] = e
        for level, stage in enumerate(e.stages()):
            self.window(level, **{n: (lambda s, x=x: x) for n, x in stage.items()})
        back = {f"{n}_lag": (lambda s, n=n: F.lag(n).over(s.over)) for n in ("_e_y", "_e_log", "_e_first")}
        # The row before a block's first own row is a copy, of which the block has no mean.
        self.window(4, _e_own=lambda s: F.lag(F.col(BLK) == s.home).over(s.over), **back)

    def rows(self, **cols: Column) -> None:
        """Row features; later batches may read earlier ones."""
        self.batches.append(cols)

    def drop(self, *cols: str) -> None:
        self.dropped.extend(cols)

    def build(self) -> DataFrame:
        s = self.s
        cut = spread(self.df, s, self.back, self.ahead)
        for level in self.levels:
            if level:
                cut = cut.withColumns({n: fn(s) for n, fn in level.items()})
        if self.marks or self.decayed:
            cut = self._carried(cut)
        out = settle(cut, s)
        for batch in self.batches:
            out = out.withColumns(batch)
        return out.drop(*[c for c in self.dropped if c in out.columns])

    def _carried(self, cut: DataFrame) -> DataFrame:
        s = self.s
        tails = {n: x for e in self.decayed.values() for n, x in e.tails().items()}
        carry = carry_last(cut, s, self.marks, tails)
        for e in self.decayed.values():
            carry = e.carried(carry)
        # The first halo rows have no neighbours, so marks on them say nothing.
        sound = F.col(POS) >= F.col(BLK) * s.rows - self.back + 3
        local = {f"{n}_l": F.last(F.when(sound, m), True).over(s.upto) for n, m in self.marks.items()}
        out = cut.withColumns(local).join(carry, [*s.keys, BLK])
        found = {
            n: fn(F.col(POS), F.coalesce(F.col(f"_m_{n}_l"), F.col(f"_m_{n}")), F.col("_origin"))
            for n, fn in self.runs.items()
        }
        for n, e in self.decayed.items():
            before = e.mean(F.col("_e_y_lag"), F.col("_e_log_lag"), F.col("_e_first_lag"))
            found[n] = F.when(F.col("_e_own"), before).otherwise(F.col("_e_in"))
        temps = [*EWM_COLUMNS, "_e_own", "_e_y_lag", "_e_log_lag", "_e_first_lag"] if self.decayed else []
        return out.withColumns(found).drop(*local, *self.marks, "_origin", *temps)
