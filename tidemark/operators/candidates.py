"""Panels that a schema suggests: templates over roles, rules that forbid, penalties that order, five that are shown."""

from __future__ import annotations

from dataclasses import dataclass, field

# Penalties by template, measure role and table role.
TEMPLATE_COST = {"T1": 0, "T2": 0, "T3": 1, "T4": 1, "T8": 1, "T5": 2, "T6": 2, "T7": 2}
MEASURE_COST = {"money": 0, "quantity": 1, "score": 1, "ratio": 1, "number": 3}
TABLE_COST = {"fact": -2, "event": -1}
NEVER_SUMMED = {"pk", "fk", "identifier", "code", "place", "calendar"}
POPULATION = {"status", "state", "type", "kind"}


@dataclass(frozen=True)
class Column:
    name: str
    role: str
    evidence: str = "measured"
    distinct: int | None = None
    nulls: float | None = 0.0
    common: float | None = None
    correlation: float | None = None


@dataclass(frozen=True)
class Table:
    name: str
    role: str
    rows: int | None
    columns: tuple[Column, ...]

    def of(self, *roles: str) -> list[Column]:
        return [c for c in self.columns if c.role in roles]


@dataclass(frozen=True)
class Candidate:
    template: str
    table: Table
    aggregate: str = "count"
    measure: Column | None = None
    time: Column | None = None
    by: Column | None = None
    join: str | None = None
    flags: tuple[str, ...] = field(default=())

    def key(self) -> tuple:
        return self.template, self.table.name, self.aggregate, *(c.name if c else "" for c in (self.measure, self.time, self.by))


def generate(tables: list[Table]) -> list[Candidate]:
    out = []
    for t in tables:
        times, categories = t.of("created", "event"), t.of("category")
        summed = [("sum", c) for c in t.of("money", "quantity")]
        averaged = [("avg", c) for c in t.of("money", "quantity", "score", "ratio")]
        for time in times:
            out.append(Candidate("T1", t, time=time))
            out += [Candidate("T3", t, op, c, time) for op, c in summed + averaged]
            out += [Candidate("T6", t, time=time, by=c) for c in categories if c.distinct is not None and c.distinct <= 6]
        out += [Candidate("T2", t, by=c) for c in categories]
        out += [Candidate("T4", t, op, m, by=c) for op, m in summed + averaged for c in categories]
        out += [Candidate("T5", t, measure=c) for c in t.of("money", "quantity", "score")]
        if t.role == "event" and times:
            out.append(Candidate("T7", t, time=times[0], flags=("shows-rows",)))
    if tables:
        out.append(Candidate("T8", max(tables, key=lambda t: (t.rows or 0, t.name))))
    return out


def forbidden(c: Candidate) -> str | None:
    """The first hard rule that a candidate breaks; a rule whose facts are unknown can't fire."""
    m = c.measure
    if m and c.aggregate in ("sum", "avg") and m.role in NEVER_SUMMED:
        return "H1"
    if m and c.aggregate == "sum" and (m.role in ("level", "ratio", "score") or (c.time and c.table.role == "snapshot")):
        return "H2"
    if c.by and (c.by.role != "category" or (c.by.distinct or 0) > 30):
        return "H3"
    if m and m.role == "money" and c.aggregate in ("sum", "avg") and c.table.of("currency") and (c.by is None or c.by.role != "currency"):
        return "H5"
    if c.time and c.time.role not in ("created", "event"):
        return "H6"
    if c.table.role in ("lookup", "link") and c.template not in ("T5", "T8"):
        return "H7"
    return "H8" if c.table.rows == 0 else None


def abstains(c: Candidate) -> str | None:
    words = {w for x in c.table.of("category") for w in [x.name.rsplit("_", 1)[-1]]}
    over = c.template == "T3" or (c.template == "T4" and c.aggregate == "sum" and c.by and c.by.name.rsplit("_", 1)[-1] not in POPULATION)
    if over and words & POPULATION:
        return "needs-population"
    return "currencies" if c.measure and c.measure.role == "money" and c.table.of("currency") else None


def penalty(c: Candidate) -> int:
    t, used = c.table, [x for x in (c.measure, c.time, c.by) if x]
    out = TEMPLATE_COST[c.template] + TABLE_COST.get(t.role, 0 if t.role == "entity" and c.template == "T1" else 1)
    out += sum({"named": 2, "typed": 3}.get(x.evidence, 0) + 2 * ((x.nulls or 0) > 0.5) for x in used)
    out += 1 if t.rows is None else 3 if t.rows < 100 else 1 if t.rows < 1000 else 0
    if c.time and (c.time.correlation or 0) >= 0.9:
        out -= 1
    if c.by:
        n = c.by.distinct
        out += (0 if c.by.evidence == "declared" else 1) if n is None else 0 if 3 <= n <= 12 else 1
        out += 3 * ((c.by.common or 0) > 0.95)
    if c.measure:
        out += MEASURE_COST.get(c.measure.role, 3)
    return out + len(c.flags) + {"declared": 1, "guessed": 2}.get(c.join or "", 0)


def five(candidates: list[Candidate], most: int = 5) -> list[tuple[Candidate, int]]:
    """Greedily from the lowest total: +3 for each panel of the same table, +5 for the same template on the same
    column, two of a table at most; ties in the order of the keys."""
    left = [c for c in candidates if forbidden(c) is None and abstains(c) is None]
    out: list[tuple[Candidate, int]] = []

    def total(c: Candidate) -> int:
        same = sum(o.table.name == c.table.name for o, _ in out)
        twin = any(o.template == c.template and (o.measure or o.by or o.time) == (c.measure or c.by or c.time) for o, _ in out)
        return penalty(c) + 3 * same + 5 * twin

    while left and len(out) < most:
        free = [c for c in left if sum(o.table.name == c.table.name for o, _ in out) < 2]
        if not free:
            break
        best = min(free, key=lambda c: (total(c), c.key()))
        out.append((best, total(best)))
        left.remove(best)
    return out
