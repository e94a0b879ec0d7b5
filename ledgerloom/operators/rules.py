"""Rules as tables: categories, banks and clients, first match wins.

A rule table has (priority, name, needles, direction); it is small and known on
the driver, so it becomes one native expression and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCOME, EXPENSE, TRANSFER, DRAWINGS = "income", "expense", "transfer", "drawings"
#: The order of types in reports.
TYPE_ORDER = (INCOME, EXPENSE, TRANSFER, DRAWINGS)
#: What no rule matches, by direction.
OTHER_IN, OTHER_OUT = "Other income (uncategorised)", "Other expenses (uncategorised)"
UNMAPPED = "UNMAPPED_CLIENT"


@dataclass(frozen=True)
class Category:
    name: str
    type: str
    needles: tuple[str, ...] = ()
    vat: bool = False
    direction: str | None = None
    vat_if_registered: bool = False

    def __post_init__(self):
        if self.type not in TYPE_ORDER:
            raise ValueError(f"category {self.name}: no such type: {self.type}")
        if self.direction not in (None, "in", "out", "any"):
            raise ValueError(f"category {self.name}: no such direction: {self.direction}")

    @property
    def way(self) -> str:
        """The direction of money that it takes: its own, or that of its type."""
        return self.direction or {INCOME: "in", EXPENSE: "out"}.get(self.type, "any")


def with_fallbacks(categories: Iterable[Category]) -> list[Category]:
    """The two catch-alls appended unless they are there."""
    out = list(categories)
    have = {c.name for c in out}
    return out + [c for c in (Category(OTHER_IN, INCOME), Category(OTHER_OUT, EXPENSE)) if c.name not in have]


def for_vat_registration(categories: Iterable[Category], registered: bool) -> list[Category]:
    return [Category(c.name, c.type, c.needles, registered and (c.vat or c.vat_if_registered), c.direction, c.vat_if_registered) for c in categories]


def first_needle(haystacks: list[Column], rules: list[tuple[str, Iterable[str], Column | None]], otherwise: Column) -> Column:
    """The name of the first rule of which a needle stands in a haystack, case aside, and whose condition holds."""
    low = [F.lower(F.coalesce(h, F.lit(""))) for h in haystacks]
    out = None
    for name, needles, condition in rules:
        hit = None
        for n in needles:
            for h in low:
                one = h.contains(n.lower())
                hit = one if hit is None else hit | one
        if hit is not None:
            hit = hit if condition is None else condition & hit
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return otherwise if out is None else out.otherwise(otherwise)


def money_in(credit: Column) -> Column:
    """Rows with a credit other than 0 are money in; all others count as out."""
    return F.coalesce(credit != 0, F.lit(False))


def categorize(description: Column, credit: Column, categories: list[Category]) -> Column:
    is_in = money_in(credit)
    rules = [(c.name, c.needles, {"in": is_in, "out": ~is_in, "any": None}[c.way]) for c in categories]
    return first_needle([description], rules, F.when(is_in, F.lit(OTHER_IN)).otherwise(F.lit(OTHER_OUT)))


def detect_bank(text: Column, banks: list[tuple[str, Iterable[str]]]) -> Column:
    return first_needle([text], [(n, needles, None) for n, needles in banks], F.lit(None).cast("string"))


def match_client(haystacks: list[Column], clients: list[tuple[str, Iterable[str]]]) -> Column:
    """The first client whose needle stands in the sender, the subject, the file name or the first page."""
    return first_needle(haystacks, [(n, needles, None) for n, needles in clients], F.lit(UNMAPPED))


def type_of(category: Column, categories: list[Category]) -> Column:
    """The type by name, the last of equal names; null for unknown ones."""
    last = {c.name: c.type for c in categories}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in last.items() for x in kv]), category) if last else F.lit(None).cast("string")


def vat_default(category: Column, categories: list[Category]) -> Column:
    """'Yes' or 'No' by name, the first of equal names; 'No' for unknown ones and for types other than income and expense."""
    first: dict[str, str] = {}
    for c in categories:
        first.setdefault(c.name, "Yes" if c.vat and c.type in (INCOME, EXPENSE) else "No")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), category) if first else F.lit(None).cast("string")
    return F.coalesce(known, F.lit("No"))


def uncategorised(category: Column) -> Column:
    return F.coalesce(category, F.lit("")).isin("", OTHER_IN, OTHER_OUT)


def report_categories(rows: DataFrame, categories: list[Category]) -> DataFrame:
    """(category, type, rank): those used, by type and then the order given; others by what they net to, then by name."""
    spark = rows.sparkSession
    zero = F.lit(0).cast("decimal(18,2)")
    used = rows.where("category is not null").groupBy("category").agg(F.sum(F.coalesce("credit", zero) - F.coalesce("debit", zero)).alias("net"))
    last = {c.name: (c.name, c.type, k) for k, c in enumerate(categories)}
    table = spark.createDataFrame(list(last.values()), "category string, type string, priority int")
    out = used.join(F.broadcast(table), "category", "left")
    kind = F.coalesce("type", F.when(F.col("net") > 0, INCOME).otherwise(EXPENSE))
    order = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), kind)
    return out.select("category", kind.alias("type"), F.struct(order.alias("t"), F.coalesce("priority", F.lit(1 << 30)).alias("p"), F.col("category").alias("c")).alias("rank"))
