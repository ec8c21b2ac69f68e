"""Business measures that can be sliced by any dimension.

A measure is made of terms. A term is a sum over fact rows under filters on columns; a filter on a column
replaces whatever the slicer or the grouping says about that same column. Terms are added up on the fact's
own keys first; only the grouped rows meet the customer and merchant tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.functions.exact import safe_div, to_money
from tillscope.operators.totals import with_totals
from tillscope.session import settle
from tillscope.star import Star

Test = Callable[[Column], Column]
Filters = Mapping[str, Test]

# Columns a measure can be sliced by, other than those of the fact itself.
METHOD_COLUMNS = ("payment_method_code", "payment_method_name", "category_type")
REASON_COLUMNS = ("failure_reason_code", "failure_reason_description", "failure_category")
CUSTOMER_COLUMNS = {
    "customer_name": "customer_name",
    "customer_segment": "customer_segment",
    "customer_city": "city",
    "customer_state": "state",
    "kyc_level": "kyc_level",
    "credit_score_band": "credit_score_band",
}
MERCHANT_COLUMNS = {
    "merchant_name": "merchant_name",
    "merchant_category": "merchant_category",
    "merchant_city": "city",
    "merchant_state": "state",
}


ENTITY_IDS = {"customer_id": CUSTOMER_COLUMNS, "merchant_id": MERCHANT_COLUMNS}


def equals(value: object) -> Test:
    return lambda c: c == value


def one_of(*values: object) -> Test:
    return lambda c: c.isin(*values)


def hours(first: int, last: int) -> Test:
    return lambda c: F.hour(c).between(first, last)


class Term(NamedTuple):
    name: str
    kind: str = "volume"
    filters: Filters = {}

    def under(self, name: str, outer: Filters) -> Term:
        """The term inside further filters; its own filter on a column wins."""
        return Term(name, self.kind, {**outer, **self.filters})


class Measure(NamedTuple):
    """A value over summed terms.

    ``kind`` is plain; customer or merchant (an aggregate over one row of terms per entity); customers or merchants (a
    count of the dimension); per_merchant or top (loss per merchant, share of the largest merchants).
    """

    title: str
    terms: tuple[Term, ...]
    value: Callable[[], Column] | None
    kind: str = "plain"


STATUS, REASON, CATEGORY = "transaction_status", "failure_reason_code", "failure_category"

GMV = Term("gmv")
OK_VOLUME = Term("ok_volume", "volume", {STATUS: equals("SUCCESS")})
FAILED_VOLUME = Term("failed_volume", "volume", {STATUS: equals("FAILED")})
FRAUD_VOLUME = Term("fraud_volume", "volume", {STATUS: equals("FRAUD_BLOCKED")})
ALL_ROWS = Term("all_rows", "rows")
OK_ROWS = Term("ok_rows", "rows", {STATUS: equals("SUCCESS")})
FAILED_ROWS = Term("failed_rows", "rows", {STATUS: equals("FAILED")})
FRAUD_ROWS = Term("fraud_rows", "rows", {STATUS: equals("FRAUD_BLOCKED")})
RISK = Term("risk", "risk")
RISK_ROWS = Term("risk_rows", "risk_rows")
PRICED_ROWS = Term("priced_rows", "priced_rows")
INFRA = Term("infra", "volume", {CATEGORY: equals("Infrastructure")})
TIMEOUT = Term("timeout", "volume", {REASON: equals("GATEWAY_TIMEOUT")})

PEAK: Filters = {
    "customer_city": equals("Tier-2 Cities"),
    "payment_method_code": equals("upi"),
    "is_fraud": equals(0),
}
CLEAN: Filters = {"is_fraud": equals(0)}
NIGHT: Filters = {"transaction_timestamp": hours(0, 5)}
ABROAD: Filters = {"is_international": equals(1)}

MIN_SPEND_CENTS = 25_000 * 100
MIN_FAILED_PCT = 20
SLA = 0.865
TOP_MERCHANTS = 20


def _t(term: Term | str) -> Column:
    return F.col(term if isinstance(term, str) else term.name)


def _volume(title: str, term: Term) -> Measure:
    return Measure(title, (term,), lambda: to_money(_t(term)))


def _rows(title: str, term: Term) -> Measure:
    return Measure(title, (term,), lambda: _t(term))


def _rate(title: str, part: Term, whole: Term) -> Measure:
    return Measure(title, (part, whole), lambda: safe_div(_t(part), _t(whole)))


def _lost(title: str, name: str, column: str, test: Test) -> Measure:
    return _volume(title, Term(name, "volume", {column: test}))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


PEAK_FAILED, PEAK_ROWS = FAILED_ROWS.under("peak_failed", PEAK), ALL_ROWS.under("peak_rows", PEAK)
CLEAN_FAILED, CLEAN_ROWS = FAILED_ROWS.under("clean_failed", CLEAN), ALL_ROWS.under("clean_rows", CLEAN)


def _peak_rate() -> Column:
    return safe_div(_t(PEAK_FAILED), _t(PEAK_ROWS))


def _clean_rate() -> Column:
    return safe_div(_t(CLEAN_FAILED), _t(CLEAN_ROWS))


def _high_spend() -> Column:
    return _t(GMV) >= MIN_SPEND_CENTS


def _at_risk() -> Column:
    return _high_spend() & (_t(FAILED_ROWS) * 100 >= _t(ALL_ROWS) * MIN_FAILED_PCT)


def _at_risk_spend() -> Column:
    return F.sum(F.when(_at_risk(), _t(GMV)))


ENTITY = (GMV, ALL_ROWS, FAILED_ROWS)

MEASURES: dict[str, Measure] = {
    "total_gross_volume_gmv": _volume("Total Gross Volume GMV", GMV),
    "successful_volume": _volume("Successful Volume", OK_VOLUME),
    "revenue_at_risk_failed": _volume("Revenue at Risk (Failed)", FAILED_VOLUME),
    "fraud_blocked_volume": _volume("Fraud Blocked Volume", FRAUD_VOLUME),
    "total_transactions": _rows("Total Transactions", ALL_ROWS),
    "successful_transactions": _rows("Successful Transactions", OK_ROWS),
    "failed_transactions": _rows("Failed Transactions", FAILED_ROWS),
    "fraud_blocked_transactions": _rows("Fraud Blocked Transactions", FRAUD_ROWS),
    "success_rate": _rate("Success Rate %", OK_ROWS, ALL_ROWS),
    "failure_rate": _rate("Failure Rate %", FAILED_ROWS, ALL_ROWS),
    "fraud_rate": _rate("Fraud Rate %", FRAUD_ROWS, ALL_ROWS),
    "average_ticket_size": Measure(
        "Average Ticket Size",
        (GMV, PRICED_ROWS),
        lambda: F.try_divide(_t(GMV).cast("double"), _t(PRICED_ROWS).cast("double")) / 100.0,
    ),
    "average_risk_score": Measure(
        "Average Risk Score",
        (RISK, RISK_ROWS),
        lambda: F.try_divide(_t(RISK).cast("double"), _t(RISK_ROWS).cast("double")) / 10.0,
    ),
    "infrastructure_lost_revenue": _volume("Infrastructure Lost Revenue", INFRA),
    "customer_side_lost_revenue": _lost(
        "Customer Side Lost Revenue", "customer_side", CATEGORY, equals("Customer Side")
    ),
    "risk_compliance_lost_revenue": _lost(
        "Risk & Compliance Lost Revenue", "risk_compliance", CATEGORY, equals("Risk & Compliance")
    ),
    "gateway_timeout_lost_volume": _volume("Gateway Timeout Lost Volume", TIMEOUT),
    "technical_error_lost_volume": _lost(
        "Technical Error Lost Volume", "technical", REASON, equals("TECHNICAL_ERROR")
    ),
    "bank_declined_lost_volume": _lost("Bank Declined Lost Volume", "declined", REASON, equals("BANK_DECLINED")),
    "insufficient_funds_lost_volume": _lost(
        "Insufficient Funds Lost Volume", "funds", REASON, equals("INSUFFICIENT_FUNDS")
    ),
    "infrastructure_loss_share": Measure(
        "Infrastructure Loss Share %",
        (INFRA, FAILED_VOLUME, FRAUD_VOLUME),
        lambda: safe_div(_t(INFRA), _zero(_t(FAILED_VOLUME)) + _zero(_t(FRAUD_VOLUME))),
    ),
    "infrastructure_loss_share_of_failed": _rate("Infrastructure Loss Share % (failed only)", INFRA, FAILED_VOLUME),
    "recoverable_baseline_gmv": _lost(
        "Recoverable Baseline GMV", "recoverable", REASON, one_of("GATEWAY_TIMEOUT", "TECHNICAL_ERROR")
    ),
    "peak_fail_rate": Measure("July Peak UPI Tier2 Fail Rate %", (PEAK_FAILED, PEAK_ROWS), _peak_rate),
    "peak_total_volume": _volume("July Peak UPI Tier2 Total Volume", GMV.under("peak_volume", PEAK)),
    "peak_timeout_lost_volume": _volume(
        "July Peak UPI Tier2 Timeout Lost Volume", TIMEOUT.under("peak_timeout", PEAK)
    ),
    "baseline_failure_rate": Measure(
        "Baseline Non-Fraud Failure Rate %", (CLEAN_FAILED, CLEAN_ROWS), _clean_rate
    ),
    "peak_vs_baseline_delta": Measure(
        "Peak vs Baseline Failure Rate Delta %",
        (PEAK_FAILED, PEAK_ROWS, CLEAN_FAILED, CLEAN_ROWS),
        lambda: _peak_rate() - _clean_rate(),
    ),
    "total_customers": Measure("Total Customers", (), lambda: F.countDistinct("customer_id"), "customers"),
    "high_spend_customers": Measure(
        "High-Spend Customers Count", ENTITY, lambda: F.count_if(_high_spend()), "customer"
    ),
    "at_risk_customers": Measure(
        "At-Risk High-Value Customers Count", ENTITY, lambda: F.count_if(_at_risk()), "customer"
    ),
    "at_risk_customer_spend": Measure(
        "At-Risk Customer Spend", ENTITY, lambda: to_money(_at_risk_spend()), "customer"
    ),
    "at_risk_customer_spend_share": Measure(
        "At-Risk Customer Spend Share %", ENTITY, lambda: safe_div(_at_risk_spend(), F.sum(_t(GMV))), "customer"
    ),
    "total_merchants": Measure("Total Merchants", (), lambda: F.countDistinct("merchant_id"), "merchants"),
    "merchants_with_failures": Measure(
        "Merchants with Failures Count", (FAILED_ROWS,), lambda: F.count_if(_t(FAILED_ROWS) > 0), "merchant"
    ),
    "avg_lost_revenue_per_merchant": Measure(
        "Avg Lost Revenue per Merchant",
        (FAILED_VOLUME,),
        None,
        "per_merchant",
    ),
    "top_20_merchant_loss_share": Measure("Top 20 Merchant Loss Share %", (FAILED_VOLUME,), None, "top"),
    "gateway_success_rate": _rate("Gateway Success Rate %", OK_ROWS, ALL_ROWS),
    "gateway_timeout_rate": _rate(
        "Gateway Timeout Rate %", Term("timeout_rows", "rows", {REASON: equals("GATEWAY_TIMEOUT")}), ALL_ROWS
    ),
    "technical_error_rate": _rate(
        "Technical Error Rate %", Term("technical_rows", "rows", {REASON: equals("TECHNICAL_ERROR")}), ALL_ROWS
    ),
    "gateway_sla_status": Measure(
        "Gateway SLA Status",
        (OK_ROWS, ALL_ROWS),
        lambda: F.when(safe_div(_t(OK_ROWS), _t(ALL_ROWS)) >= SLA, "SLA Compliant (>= 86.5%)").otherwise(
            "SLA Breach (< 86.5%)"
        ),
    ),
    "off_hours_fraud_volume": _volume("Off-Hours Fraud Volume", FRAUD_VOLUME.under("night_fraud", NIGHT)),
    "off_hours_fraud_rate": _rate(
        "Off-Hours Fraud Rate %",
        FRAUD_ROWS.under("night_fraud_rows", NIGHT),
        ALL_ROWS.under("night_rows", NIGHT),
    ),
    "international_fraud_loss_share": _rate(
        "International Fraud Loss %", FRAUD_VOLUME.under("abroad_fraud", ABROAD), FRAUD_VOLUME
    ),
}


def find(name: str) -> str:
    """Key of a measure given by key or by title."""
    if name in MEASURES:
        return name
    for key, m in MEASURES.items():
        if m.title == name:
            return key
    raise KeyError(f"no measure named {name!r}")


def _is_entity_column(name: str) -> bool:
    return name in CUSTOMER_COLUMNS or name in MERCHANT_COLUMNS


def _all(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


KIND_VALUE = {
    "volume": lambda: F.col("amount_cents"),
    "rows": lambda: F.lit(1).cast("bigint"),
    "risk": lambda: (F.col("risk_score") * 10).cast("bigint"),
    "risk_rows": lambda: F.when(F.col("risk_score").isNotNull(), F.lit(1).cast("bigint")),
    "priced_rows": lambda: F.when(F.col("amount_cents").isNotNull(), F.lit(1).cast("bigint")),
}

# Rows that pass every slicer: a group is shown only where it has one.
SHOWN = "_shown"


def term_sums(star: Star, terms: Sequence[Term], keys: Sequence[str], where: Filters) -> DataFrame:
    """One row per combination of ``keys``, with each term summed under its own filters.

    Terms that need a customer or merchant column, where the others do not, are folded apart from them: only the
    rows they can count are grouped by customer or merchant.
    """
    terms = _unique(terms)
    shown = Term(SHOWN, "rows")
    near = [t for t in terms if any(_is_entity_column(c) for c in t.filters)]
    if not near or any(_is_entity_column(c) or c in ENTITY_IDS for c in (*keys, *where)):
        return _fill_rows(_fold(star, [*terms, shown], keys, where), terms)
    far = [t for t in terms if t not in near]
    frames = [_fold(star, [*far, shown], keys, where), _fold(star, near, keys, where)]
    return _fill_rows(_align(frames, keys), terms)


def _fold(star: Star, terms: Sequence[Term], keys: Sequence[str], where: Filters) -> DataFrame:
    """The sums of ``term_sums`` in two steps.

    Fact rows are folded on the keys found in the fact and on the customer or merchant id where one of their
    columns is needed; then the grouped rows get those columns and are folded to ``keys``.
    """
    tests = {t.name: {**where, **t.filters} for t in terms}
    used = {c for t in tests.values() for c in t} | set(keys)
    rows = star.fact
    if used & set(METHOD_COLUMNS):
        rows = rows.join(star.methods.select("payment_method_id", *METHOD_COLUMNS), "payment_method_id", "left")
    if used & set(REASON_COLUMNS):
        rows = rows.join(star.reasons.select("failure_reason_id", *REASON_COLUMNS), "failure_reason_id", "left")
    if "txn_hour" in used:
        rows = rows.withColumn("txn_hour", F.hour("transaction_timestamp"))
    if "txn_month" in used:
        rows = rows.withColumn("txn_month", F.month("transaction_timestamp"))

    def row_test(t: Term) -> Column:
        return _all([p(F.col(c)) for c, p in tests[t.name].items() if not _is_entity_column(c)])

    # Rows no term can count need no work: this lets slicers and shared filters reach the scan.
    rows = rows.where(reduce(Column.__or__, [row_test(t) for t in terms]))

    ids = [i for i, columns in ENTITY_IDS.items() if used & set(columns) or i in keys]
    own = [k for k in keys if not _is_entity_column(k) and k not in ids]
    sums = [F.sum(F.when(row_test(t), KIND_VALUE[t.kind]())).alias(t.name) for t in terms]
    grouped = rows.groupBy(*own, *ids).agg(*sums)
    if not any(_is_entity_column(c) for c in used):
        return grouped

    for id_name, columns, table in (
        ("customer_id", CUSTOMER_COLUMNS, star.customers),
        ("merchant_id", MERCHANT_COLUMNS, star.merchants),
    ):
        wanted = [c for c in columns if c in used]
        if wanted:
            names = table.select(id_name, *[F.col(columns[c]).alias(c) for c in wanted])
            grouped = grouped.join(names, id_name, "left")
    folded = []
    for t in terms:
        entity_test = _all([p(F.col(c)) for c, p in tests[t.name].items() if _is_entity_column(c)])
        folded.append(F.sum(F.when(entity_test, F.col(t.name))).alias(t.name))
    return grouped.groupBy(*keys).agg(*folded)


def _fill_rows(df: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """Counts of no rows are 0; sums of no rows stay missing."""
    return df.na.fill(0, [SHOWN, *[t.name for t in terms if t.kind in ("rows", "risk_rows", "priced_rows")]])


def replace_filters(df: DataFrame, terms: Sequence[Term], keys: Sequence[str]) -> DataFrame:
    """Give each term that filters a grouping column the same value in every group of that column."""
    columns = {t.name: F.col(t.name) for t in terms}
    for t in terms:
        lifted = [k for k in keys if k in t.filters]
        if lifted:
            rest = [k for k in keys if k not in lifted]
            if rest:
                columns[t.name] = F.sum(t.name).over(Window.partitionBy(*rest)).alias(t.name)
            else:
                whole = df.agg(F.lit(0).alias("_one"), F.sum(t.name).alias(f"_{t.name}"))  # one row
                df = df.withColumn("_one", F.lit(0)).join(F.broadcast(whole), "_one").drop("_one")
                columns[t.name] = F.col(f"_{t.name}").alias(t.name)
    return df.select(*keys, *columns.values(), SHOWN).where(F.col(SHOWN) > 0 if keys else F.lit(True))


class Folds:
    """The star's term sums at any level of ``by``, from one fold of the fact for each kind of entity that the measures need.

    Sums add up over groups and entities, and a term's own filters are in them. So a level is summed from the fold, and only then do
    filters replace the grouping. Plain measures use the fold of an entity where there is one. Slicers that a measure drops ask
    for one more fold.
    """

    def __init__(self, star: Star, names: Sequence[str], by: Sequence[str]):
        self.star, self.by, self.folds = star, list(by), {}
        kinds = {"customer": "customer_id", "merchant": "merchant_id", "per_merchant": "merchant_id", "top": "merchant_id"}
        self.terms: dict[tuple[str, ...], list[Term]] = {}
        for n in names:
            ids = tuple(i for i in [kinds.get(MEASURES[n].kind)] if i and i not in by)
            self.terms.setdefault(ids, []).extend(MEASURES[n].terms)
        finest = max(self.terms, key=len, default=())
        if finest and () in self.terms:
            self.terms[finest] += self.terms.pop(())

    @property
    def customers(self) -> DataFrame:
        return self.star.customers

    @property
    def merchants(self) -> DataFrame:
        return self.star.merchants

    def sums(self, terms: Sequence[Term], keys: Sequence[str], where: Filters) -> DataFrame:
        ids = tuple(k for k in keys if k in ENTITY_IDS and k not in self.by)
        terms = _unique(terms)
        if ids not in self.terms:  # any fold with these terms will do
            held = [i for i, own in self.terms.items() if {t.name for t in terms} <= {t.name for t in own}]
            ids = held[0] if held else ids
        slot = ids, tuple(sorted(where))
        if slot not in self.folds:
            self.folds[slot] = settle(term_sums(self.star, self.terms.get(ids, terms), [*self.by, *ids], where))
        folded = self.folds[slot].groupBy(*keys).agg(*[F.sum(n).alias(n) for n in (SHOWN, *(t.name for t in terms))])
        return _fill_rows(folded, terms)


Source = Star | Folds


def _visual_terms(star: Source, terms: Sequence[Term], keys: Sequence[str], where: Filters) -> DataFrame:
    sums = star.sums if isinstance(star, Folds) else lambda *a: term_sums(star, *a)
    return replace_filters(sums(terms, keys, where), _unique(terms), keys)


def _unique(terms: Sequence[Term]) -> list[Term]:
    return list({t.name: t for t in terms}.values())


def _plain(star: Source, names: Sequence[str], by: Sequence[str], where: Filters) -> DataFrame:
    terms = _unique([t for n in names for t in MEASURES[n].terms])
    return _visual_terms(star, terms, by, where).select(*by, *[MEASURES[n].value().alias(n) for n in names])


def _customer_frame(star: Source, names: Sequence[str], by: Sequence[str], where: Filters) -> DataFrame:
    """Measures over the customers of each group: fold per customer, test, fold again."""
    terms = _unique([t for n in names for t in MEASURES[n].terms])
    per_customer = _visual_terms(star, terms, [*by, "customer_id"], where).where(F.col("customer_id").isNotNull())
    return per_customer.groupBy(*by).agg(*[MEASURES[n].value().alias(n) for n in names])


def _table_count(star: Source, name: str, by: Sequence[str], where: Filters) -> tuple[DataFrame, list[str]]:
    """Members of a dimension per group. Fact columns do not filter a dimension."""
    kind = MEASURES[name].kind
    table, columns = (star.customers, CUSTOMER_COLUMNS) if kind == "customers" else (star.merchants, MERCHANT_COLUMNS)
    own = [c for c in by if c in columns]
    key = "customer_id" if kind == "customers" else "merchant_id"
    named = table.select(key, *[F.col(columns[c]).alias(c) for c in {*own, *[w for w in where if w in columns]}])
    kept = named.where(_all([where[c](F.col(c)) for c in where if c in columns]))
    return kept.groupBy(*own).agg(MEASURES[name].value().alias(name)), own


def _spread(df: DataFrame, own: list[str], spine: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repeat per-dimension values for every group of ``by`` that has them."""
    if list(own) == list(by):
        return df
    value = [c for c in df.columns if c not in own]
    if not own:
        return with_totals(spine.select(*by), df)
    right = df.select(*[F.col(c).alias(f"_{c}") for c in own], *value)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
    return spine.join(right, same, "left").select(*by, *value)


def _dimension_frames(star: Source, names: Sequence[str], by: Sequence[str], where: Filters) -> list[DataFrame]:
    frames = []
    for n in names:
        counted, own = _table_count(star, n, by, where)
        spine = counted if own == list(by) else _visual_terms(star, [], by, where)
        frames.append(_spread(counted, own, spine, by))
    return frames


def _merchant_frames(star: Source, names: Sequence[str], by: Sequence[str], where: Filters) -> list[DataFrame]:
    """All measures that need one row per group and merchant, from a single fold of the fact."""
    loss = FAILED_VOLUME.name
    terms = _unique([t for n in names for t in MEASURES[n].terms])
    base = _visual_terms(star, terms, [*by, "merchant_id"], where)
    if any(MEASURES[n].kind != "merchant" for n in names):
        # Read more than once below; it has one row per merchant and group, so it is small next to the fact.
        base = settle(base)
    known = base.where(F.col("merchant_id").isNotNull())

    def total_loss(keys: list[str], slicers: Filters) -> DataFrame:
        if STATUS in by or len(slicers) < len(where):
            out = _visual_terms(star, [FAILED_VOLUME], keys, slicers)
        else:
            out = base.groupBy(*keys).agg(F.sum(loss).alias(loss))
        return out.select(*keys, F.col(loss).alias("all_loss"))

    frames = []
    counts = [n for n in names if MEASURES[n].kind == "merchant"]
    if counts:
        frames.append(known.groupBy(*by).agg(*[MEASURES[n].value().alias(n) for n in counts]))
    for n in names:
        if MEASURES[n].kind == "per_merchant":
            lost = total_loss(list(by), where)
            counted, own = _table_count(star, "total_merchants", by, where)
            both = _align([lost, _spread(counted, own, lost, by)], by)
            each = safe_div(F.col("all_loss"), F.col("total_merchants")) / 100.0
            frames.append(both.select(*by, each.alias(n)))
        if MEASURES[n].kind == "top":
            rest = [k for k in by if k not in MERCHANT_COLUMNS]
            whole = total_loss(rest, {c: t for c, t in where.items() if c not in MERCHANT_COLUMNS})
            best = _top_loss(known, by)
            if rest != list(by):
                whole = _spread(whole, rest, best, by)
            frames.append(
                _align([best, whole], by).select(
                    *by, safe_div(F.col("top_loss"), F.col("all_loss")).alias(n)
                )
            )
    return frames


def _top_loss(per_merchant: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failed volume of the largest merchants of each group; ties at the cut are kept.

    Merchants of equal loss are folded into one row first, so a tie of any size takes one row, and no task gets
    more than the leading rows of each input partition.
    """
    loss = FAILED_VOLUME.name
    levels = per_merchant.where(F.col(loss).isNotNull()).groupBy(*by, loss).agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by).orderBy(F.desc(loss))
    return (
        levels.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= TOP_MERCHANTS)
        .withColumn("ahead", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
        .where(F.col("ahead") < TOP_MERCHANTS)
        .groupBy(*by)
        .agg(F.sum(F.col(loss) * F.col("m")).alias("top_loss"))
    )


def _align(frames: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Frames with the same groups and different columns, side by side."""
    if len(frames) == 1:
        return frames[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in by])


def evaluate(star: Source, names: Sequence[str], by: Sequence[str] = (), where: Filters | None = None) -> DataFrame:
    """The named measures per group of ``by``, under the slicers ``where`` (column -> test)."""
    names, where = [find(n) for n in names], dict(where or {})
    def of(*wanted: str) -> list[str]:
        return [n for n in names if MEASURES[n].kind in wanted]

    frames = []
    if of("plain"):
        frames.append(_plain(star, of("plain"), by, where))
    if of("customer"):
        frames.append(_customer_frame(star, of("customer"), by, where))
    if of("merchant", "per_merchant", "top"):
        frames += _merchant_frames(star, of("merchant", "per_merchant", "top"), by, where)
    frames += _dimension_frames(star, of("customers", "merchants"), by, where)
    return _align(frames, by).select(*by, *names)


def evaluate_with_totals(
    star: Star, names: Sequence[str], by: Sequence[str], where: Filters | None = None
) -> DataFrame:
    """Any measures per group, with a subtotal per leading group and a grand total.

    ``totals_level`` is the number of grouping columns summed away. Each level is evaluated in its own filter context, from folds of
    the fact that all levels share: one, or one for customers and one for merchants, whatever the number of columns.
    """
    names, where = [find(n) for n in names], dict(where or {})
    folds = Folds(star, names, by)
    levels = [
        evaluate(folds, names, by[:left], where).withColumn("totals_level", F.lit(len(by) - left)) for left in range(len(by), -1, -1)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)
    return stacked.select(*by, "totals_level", *names)


CORE = list(MEASURES)[:13]
LEAKAGE = list(MEASURES)[13:28]
CUSTOMER_MERCHANT = list(MEASURES)[28:37]
GATEWAY_FRAUD = list(MEASURES)[37:]
