"""The five gates and the freeze: each is a set of violation queries over DataFrames.

A gate passes when it finds no violation. Row-level checks of one table share a pass;
key-level checks are combining aggregations; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgate.functions.identity import in_scope, well_formed_sha256
from pitgate.functions.numbers import ohlc_valid
from pitgate.operators.aggregates import completeness, content_digest
from pitgate.operators.bars import transition_bar_checks
from pitgate.operators.checks import (
    beside, duplicate_keys, failed_checks, gather, key_text, row_violations, violations,
)
from pitgate.operators.joins import at_keys, lifecycle_status, missing_keys, override_hits, set_sides
from pitgate.operators.state import NEW_REGIME, OLD_REGIME
from pitgate.operators.trading_days import calendar_mismatch, venue_days, weekdays
from pitgate.plans.facts import canonical_fingerprint, unequal_pairs
from pitgate.schema import KEYS, SECURITY, Rules

DAY = [*SECURITY, "trade_date"]


def _one_sided(sides: DataFrame, left: str, right: str, *keys: str) -> DataFrame:
    """Violations for keys that only one of two sets holds."""
    check = F.when(F.col("in_left"), left).otherwise(right)
    return sides.where("in_left <> in_right").select(
        check.alias("check"), key_text(*keys).alias("key"), F.lit("").alias("detail"))


def _duplicates(df: DataFrame, keys, check: str) -> DataFrame:
    return violations(duplicate_keys(df, keys), check, key_text(*keys), F.col("n"))


def _required(df: DataFrame, condition: Column, check: str, key: Column) -> DataFrame:
    """A violation unless the one-row frame meets the condition."""
    return violations(df.where(~F.coalesce(condition, F.lit(False))), check, key)


def master_gate(master: DataFrame, control: DataFrame, minimum: dict[str, int], listed: str = "code") -> DataFrame:
    """Scope, duplicates, weak evidence, size, and equality with the independent control.

    ``listed`` is the column with the six-digit code whose prefix names the board, where ``code`` is a longer key.
    """
    code, exchange = F.col(listed), F.col("exchange")
    rows = row_violations(master, key_text(*SECURITY), {
        "invalid exchange": exchange.isin("SSE", "SZSE"),
        "out-of-scope row": (F.col("board") == "MAIN") & (F.col("security_type") == "A_SHARE"),
        "technology-board code of the first venue": ~((exchange == "SSE") & code.rlike("^68[89]")),
        "growth-board code of the second venue": ~((exchange == "SZSE") & code.rlike("^30[01]")),
        "board only guessed from the code": ~F.col("board_basis").eqNullSafe(F.lit("DERIVED_CODE_PREFIX")),
    })
    sizes = master.agg(*[F.count_if(exchange == e).alias(e) for e in minimum])
    small = [_required(sizes, F.col(e) >= n, "fewer securities than plausible", F.lit(e)) for e, n in minimum.items()]
    sides = _one_sided(set_sides(master, control, SECURITY), "only in primary", "only in control", *SECURITY)
    return gather(rows, _duplicates(master, SECURITY, "duplicate security"), sides, *small)


def lifecycle_gate(master: DataFrame, intervals: DataFrame, events: DataFrame,
                   transitions: DataFrame, declared: DataFrame, rules: Rules) -> DataFrame:
    """Open intervals equal the master; every end has evidence; code changes are honoured.

    ``declared`` is the manifest's ``(name, expected)`` list of counts.
    """
    scope = {"out-of-scope lifecycle row": in_scope(F.col("exchange"), F.col("code"))}
    open_ones = intervals.where("listed_to_exclusive is null")
    closed = intervals.where("listed_to_exclusive is not null")
    delists = events.where("event_type = 'DELIST'")
    old = transitions.select("exchange", F.col("old_code").alias("code"))
    found = [
        _one_sided(set_sides(master, open_ones, SECURITY), "current security without open interval",
                   "open interval without current security", *SECURITY),
        _duplicates(intervals, SECURITY, "multiple intervals for security"),
        row_violations(events, key_text(*SECURITY, "event_type"), {
            **scope, "invalid effective_date": F.col("effective_date").isNotNull()}),
        row_violations(intervals, key_text(*SECURITY), {
            **scope, "non-positive interval": F.coalesce(
                F.col("listed_to_exclusive") > F.col("listed_from"), F.col("listed_from").isNotNull())}),
        _duplicates(delists, SECURITY, "duplicate DELIST security"),
        violations(at_keys(master, delists, SECURITY), "current and delisted", key_text(*SECURITY)),
        _one_sided(set_sides(closed, delists.select(*SECURITY).unionByName(old), SECURITY),
                   "closed interval without evidence", "evidence without closed interval", *SECURITY),
    ]
    shape = events.agg(
        F.min("effective_date").alias("first"),
        *[F.count_if((F.col("exchange") == e) & (F.col("event_type") == "DELIST")).alias(e) for e in ("SSE", "SZSE")])
    found.append(_required(shape, F.col("first") <= F.lit(rules.coverage_start),
                           "lifecycle evidence starts after the coverage", F.col("first").cast("string")))
    found += [_required(shape, F.col(e) > 0, "venue without any delisting", F.lit(e)) for e in ("SSE", "SZSE")]

    life = lambda side: intervals.select(
        "exchange", F.col("code").alias(f"{side}_code"), F.col("listed_from").alias(f"{side}_from"),
        F.col("listed_to_exclusive").alias(f"{side}_to"), F.col("list_evidence_class").alias(f"{side}_list"),
        F.col("delist_evidence_class").alias(f"{side}_delist"), F.lit(True).alias(f"{side}_found"))
    both = (transitions.join(life("old"), ["exchange", "old_code"], "left")
            .join(life("new"), ["exchange", "new_code"], "left"))
    eff, evidence = F.col("effective_date"), F.col("evidence_class")
    has = lambda side: F.coalesce(F.col(f"{side}_found"), F.lit(False))
    found.append(row_violations(both, key_text("exchange", "old_code", "new_code"), {
        "predecessor has no interval": has("old"),
        "predecessor ends on another day": ~has("old") | F.col("old_to").eqNullSafe(eff),
        "end of predecessor has other evidence": ~has("old") | F.col("old_delist").eqNullSafe(evidence),
        "successor has no interval": has("new"),
        "successor starts on another day": ~has("new") | F.col("new_from").eqNullSafe(eff),
        "successor is closed": ~has("new") | F.col("new_to").isNull(),
        "start of successor has other evidence": ~has("new") | F.col("new_list").eqNullSafe(evidence),
    }))
    counts = [
        (master, "current_active"), (delists, "delisted_a_all_history"), (intervals, "expected_intervals"),
        (events, "lifecycle_events"), (transitions, "code_transitions")]
    actual = gather(*[df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(n).alias("name"), "value")
                      for df, n in counts])
    off = declared.join(actual, "name").where("expected <> value")
    found.append(violations(off, "manifest count mismatch", F.col("name"), F.concat_ws(" <> ", "expected", "value")))
    return gather(*found)


def bars_gate(bars: DataFrame, life: DataFrame, sources: DataFrame, day_sources: DataFrame,
              files: DataFrame, rules: Rules, first: str = "SSE",
              second: str = "SZSE") -> tuple[DataFrame, DataFrame]:
    """``(violations, warnings)`` of the stored bars.

    ``sources`` per security of the first venue: shard, shards, exchange, code, sha256,
    bytes, normalized_rows. ``day_sources`` per requested day of the second: exchange, day,
    sha256, bytes, source_rows, normalized_rows. ``files``: exchange, year, rows, sha256
    (a digest of content). ``bars`` carry their stored ``year``.
    """
    placed = lifecycle_status(bars, life, "trade_date", rules)
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    data = row_violations(placed, key_text(*DAY), {
        "row outside lifecycle": F.col("lifecycle_status") == "INSIDE",
        "year mismatch": F.year("trade_date") == F.col("year"),
        "OHLC invariant failed": ohlc_valid(*prices),
        "negative volume/amount": (F.col("volume_shares") >= 0) & (F.col("amount_cny") >= 0),
    })
    origin = row_violations(sources, key_text(*SECURITY), {
        "bad source sha": well_formed_sha256(F.col("sha256")), "empty source": F.col("bytes") > 0})
    requested = row_violations(day_sources, key_text("exchange", "day"), {
        "bad source sha": well_formed_sha256(F.col("sha256")), "empty source": F.col("bytes") > 0,
        "day with data but none in scope": (F.col("source_rows") <= 0) | (F.col("normalized_rows") > 0)})

    relevant = life.where((F.col("listed_from") <= F.lit(rules.coverage_end)) & (
        F.col("listed_to_exclusive").isNull() | (F.col("listed_to_exclusive") > F.lit(rules.coverage_start))))
    expected = relevant.where(F.col("exchange") == first)
    shards = completeness(sources, "shard", "shards")

    content = F.concat_ws(",", *[F.col(c).cast("string") for c in KEYS["bar"]],
                          *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume_shares", "amount_cny")])
    stored = bars.groupBy("exchange", "year").agg(
        F.count(F.lit(1)).alias("data_rows"), content_digest(content).alias("data_sha256"))
    accounted = files.join(stored, ["exchange", "year"], "full_outer")
    per_file = row_violations(accounted, key_text("exchange", "year"), {
        "missing data file": F.col("data_rows").isNotNull(), "file without manifest": F.col("rows").isNotNull(),
        "row-count mismatch": F.coalesce(F.col("rows") == F.col("data_rows"), F.lit(True)),
        "data sha mismatch": F.coalesce(F.col("sha256") == F.col("data_sha256"), F.lit(True))})
    normalized = sources.groupBy("exchange").agg(F.sum("normalized_rows").alias("normalized")).unionByName(
        day_sources.groupBy("exchange").agg(F.sum("normalized_rows").alias("normalized")))
    scanned = stored.groupBy("exchange").agg(F.sum("data_rows").alias("scanned"))
    totals = normalized.join(scanned, "exchange", "full_outer")

    spark = bars.sparkSession
    wanted = weekdays(spark, rules.coverage_start, rules.coverage_end)
    days = venue_days(bars)
    positive = day_sources.where("source_rows > 0")
    found = gather(
        data, origin, requested, per_file,
        _duplicates(bars, DAY, "duplicate key"), _duplicates(sources, SECURITY, "security in several shards"),
        violations(shards.where("not complete"), "missing shards", F.col("shards_found").cast("string")),
        _one_sided(set_sides(expected, sources, SECURITY), "expected security without source",
                   "source without expected security", *SECURITY),
        _one_sided(set_sides(wanted, day_sources, ["day"]), "weekday not requested", "requested day not a weekday", "day"),
        _one_sided(set_sides(positive, days.where(F.col("exchange") == second), ["exchange", "day"]),
                   "positive source day without data", "data day without positive source", "exchange", "day"),
        violations(totals.where(~F.col("normalized").eqNullSafe(F.col("scanned"))), "row accounting mismatch",
                   F.col("exchange"), F.concat_ws(" <> ", F.col("normalized").cast("string"), F.col("scanned").cast("string"))),
        violations(calendar_mismatch(days, first, second), "trading-day calendar mismatch", key_text("only", "day")),
    )
    quiet = violations(sources.where("normalized_rows = 0"), "security without rows",
                       key_text(*SECURITY))
    return found, quiet


def bar_files_gate(orders: DataFrame, rules: Rules, venues: tuple[str, ...] = ("SSE", "SZSE")) -> DataFrame:
    """Each stored file's header and order, and a file for every year of the coverage.

    ``orders``: exchange, year and what ``sources.files.csv_orders`` says of each file.
    """
    key = key_text("exchange", "year")
    text = lambda c: F.coalesce(F.replace(F.col(c), F.lit("\x1f"), F.lit(":")), F.lit(""))
    years = F.explode(F.sequence(F.lit(rules.coverage_start.year), F.lit(rules.coverage_end.year)))
    wanted = orders.sparkSession.createDataFrame([(v,) for v in venues], "exchange string").select("exchange", years.alias("year"))
    found = orders.select("exchange", F.col("year").cast("int").alias("year"))
    return gather(
        violations(orders.where(~F.coalesce("header_ok", F.lit(False))), "unexpected header", key),
        violations(orders.where("descents > 0"), "key does not rise in its file", key, text("first_descent")),
        violations(orders.where("unread > 0"), "row without a key", key, F.col("unread")),
        _one_sided(set_sides(wanted, found, ["exchange", "year"]), "year without data file",
                   "data file outside the coverage", "exchange", "year"))


def digest_violations(registered: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Registered digests (``key``, sha256) that no evidence has, or that differ from it."""
    found = actual.select(key, F.col("sha256").alias("_actual"))
    joined = registered.join(found, key, "left")
    return row_violations(joined, F.col(key), {
        "evidence missing": F.col("_actual").isNotNull(),
        "evidence digest mismatch": F.col("_actual").isNull() | (F.col("sha256") == F.col("_actual"))})


def identity_gate(bars: DataFrame, transitions: DataFrame) -> DataFrame:
    """Bars follow the code of their day across every code change."""
    return transition_bar_checks(bars, transitions)[1]


def period_violations(periods: DataFrame, rules: Rules) -> DataFrame:
    n, first, regime = F.col("trade_days"), F.col("first_date"), F.col("regime")
    reform = F.lit(rules.delisting_reform)
    old, new = regime == OLD_REGIME, regime == NEW_REGIME
    return row_violations(periods, key_text(*SECURITY), {
        "unknown delisting regime": old | new,
        "old delisting period too long": ~old | (n <= 30),
        "short period after the reform under the old regime": ~old | (first < reform) | (n > 15),
        "new delisting period too long": ~new | (n <= 15),
        "period before the reform under the new regime": ~new | (first >= reform),
    })


def state_gate(state: DataFrame, universe: DataFrame, manifest: DataFrame, periods: DataFrame,
               relisting: DataFrame, transitions: DataFrame, bars: DataFrame,
               suspended_controls: DataFrame, rules: Rules,
               unclassified: DataFrame | None = None) -> DataFrame:
    """Universe, accounting, delisting and relisting rules, code changes, point controls, bars.

    ``manifest`` lists the source securities with ``rows`` and ``sha256``;
    ``suspended_controls`` holds days officially known to be non-trading; ``unclassified``
    is the manifest's list of unclassified days, if it keeps one.
    """
    key = key_text(*DAY)
    no_limit = F.col("limit_up_rate").isNull() & F.col("limit_down_rate").isNull()
    rows = row_violations(state, key, {
        "suspended day under a trading rule": F.col("tradable") | (F.col("limit_rule") == "SUSPENDED"),
        "special day left unclassified": F.col("limit_rule") != "UNCLASSIFIED_SPECIAL_NO_LIMIT"})
    marks = periods.select(*SECURITY, "first_date", "regime")
    special = state.where(F.col("limit_rule").startswith("DELISTING_"))
    ruled = special.join(marks, list(SECURITY), "left")
    is_first = F.col("trade_date") == F.col("first_date")
    first_rule = F.col("limit_rule") == "DELISTING_15DAY_FIRST_DAY_NO_LIMIT"
    later_rule = F.col("limit_rule") == "DELISTING_CONSOLIDATION_10PCT"
    delisting = row_violations(ruled.where("regime is not null"), key, {
        "old-regime delisting day under another rule": (F.col("regime") != OLD_REGIME) | later_rule,
        "new-regime first day has a limit": (F.col("regime") != NEW_REGIME) | ~is_first | first_rule,
        "new-regime later day under another rule": (F.col("regime") != NEW_REGIME) | is_first | later_rule})
    starts = periods.select(*SECURITY, F.col("first_date").alias("trade_date"), "regime").join(
        state.select(*DAY, "limit_rule"), DAY, "left").groupBy(*DAY, "regime").agg(
            F.count("limit_rule").alias("n"), F.min("limit_rule").alias("limit_rule"))
    opened = row_violations(starts, key, {
        "delisting period without one row on its first day": F.col("n") == 1,
        "delisting period opens under another rule": (F.col("n") == 0) | F.when(
            F.col("regime") == NEW_REGIME, first_rule).otherwise(later_rule)})
    counted = state.groupBy(*SECURITY).agg(F.count(F.lit(1)).alias("state_rows"))
    accounted = manifest.join(counted, list(SECURITY), "left")
    relisted = state.join(relisting.select(*DAY), DAY, "left_semi")
    quiet = state.join(suspended_controls.select(*DAY), DAY, "left_semi")
    _, moved = transition_bar_checks(state, transitions)
    listed = [] if unclassified is None else [_one_sided(
        set_sides(unclassified, state.where("limit_rule = 'UNCLASSIFIED_SPECIAL_NO_LIMIT'"), DAY),
        "unclassified day only in manifest", "unclassified day not in manifest", *DAY)]
    return gather(
        *listed,
        rows, delisting, opened, period_violations(periods, rules),
        _duplicates(state, DAY, "duplicate state row"),
        _one_sided(set_sides(universe, manifest, SECURITY), "security missing from state sources",
                   "state source outside universe", *SECURITY),
        _one_sided(set_sides(universe, state, SECURITY), "security without state rows",
                   "state rows outside universe", *SECURITY),
        row_violations(accounted, key_text(*SECURITY), {
            "source hash missing": F.length(F.coalesce("sha256", F.lit(""))) > 0,
            "source rows differ from state rows": F.col("rows") == F.coalesce("state_rows", F.lit(0))}),
        violations(missing_keys(periods, special, SECURITY), "delisting period has no classified rows", key_text(*SECURITY)),
        violations(override_hits(state, relisting, DAY).where("n = 0"), "relisting day without state", key),
        row_violations(relisted, key, {
            "relisting day has a limit":
                (F.col("limit_rule") == "RELISTING_FIRST_DAY_NO_LIMIT") & no_limit}),
        violations(override_hits(state, suspended_controls, DAY).where("n = 0"), "suspension control row missing", key),
        row_violations(quiet, key, {"suspension control contradicted":
                                    ~F.col("tradable") & (F.col("limit_rule") == "SUSPENDED")}),
        moved.where(F.col("check") != "successor first bar is not the effective date"),
        violations(missing_keys(state.where("tradable"), bars, DAY), "traded day without bar", key),
    )


def factor_gate(events: DataFrame, manifest: DataFrame, shards: int) -> DataFrame:
    """Factor table: shards, hashes, declared counts, duplicates, unmatched, positive factors.

    ``manifest`` lists shard, exchange, code, factor_rows and sha256.
    """
    key = key_text(*KEYS["factor_event"])
    have = manifest.agg(F.count_distinct("shard").alias("n"))
    totals = beside(manifest.agg(F.sum("factor_rows").alias("declared")),
                    events.agg(F.count(F.lit(1)).alias("scanned")))
    return gather(
        row_violations(events, key, {
            "unmatched factor event": F.col("event_type") != "UNMATCHED_FACTOR_EVENT",
            "nonpositive factor": F.least("fore_adjust_factor", "back_adjust_factor", "adjust_factor") > 0}),
        _duplicates(events, KEYS["factor_event"], "duplicate factor event"),
        row_violations(manifest, key_text(*SECURITY), {"missing source hash": F.length(F.coalesce("sha256", F.lit(""))) > 0}),
        violations(have.where(F.col("n") != shards), "shard manifests missing", F.col("n").cast("string")),
        violations(totals.where(~F.col("declared").eqNullSafe(F.col("scanned"))), "events found and declared differ",
                   F.concat_ws(" <> ", F.col("scanned").cast("string"), F.col("declared").cast("string"))),
    )


def stage_gate(reports: DataFrame, config: DataFrame) -> DataFrame:
    """Every gate's evidence and its configured status must both say PASS.

    ``reports``: gate, pass. ``config``: gate, status.
    """
    joined = config.join(reports, "gate", "full_outer")
    passed = F.coalesce(F.col("pass"), F.lit(False))
    listed = F.coalesce(F.col("status") == "PASS", F.lit(False))
    return joined.select(
        F.explode(failed_checks({
            "gate evidence missing": F.col("pass").isNotNull(),
            "gate evidence does not pass": passed | F.col("pass").isNull(),
            "evidence passes but config does not": ~passed | listed})).alias("check"),
        F.col("gate").alias("key"), F.coalesce("status", F.lit("")).alias("detail"))



# What the final gate compares: figures of the ledger, the chain and the secondary control.
FINAL_PINS = [
    ("a sub-audit does not pass", "ledger.pass", "true"), ("a sub-audit does not pass", "chain.pass", "true"),
    ("a sub-audit does not pass", "control.pass", "true"),
    ("actions without a state control", "chain.controls_missing", "0"),
    ("price gaps that no share distribution explains", "chain.material_nonshare", "0"),
    ("factors contradict the chain", "control.mismatches", "0"),
    ("venue components missing", "ledger.native_missing", "0"),
    ("venue components in conflict", "ledger.native_conflicts", "0"),
]
FINAL_PAIRS = [
    ("the chain did not read every action", "ledger.official_action_count", "chain.official_action_count"),
    ("an action has no chain event", "chain.official_action_count", "chain.adjustment_event_count"),
    ("the bootstrap list is not used exactly", "chain.bootstrap_count", "chain.bootstrap_listed"),
]
FINAL_PRINTS = ("ledger.fingerprint", "chain.fingerprint", "bars.fingerprint")


def _pinned(facts: DataFrame, pins: DataFrame) -> DataFrame:
    """Violations of ``pins`` (check, name, expected) that the facts do not meet exactly."""
    joined = pins.join(facts, "name", "left").where(~F.col("expected").eqNullSafe(F.col("value")))
    return joined.select("check", F.col("name").alias("key"), F.concat_ws(
        " instead of ", F.coalesce("value", F.lit("missing")), "expected").alias("detail"))


def final_gate(facts: DataFrame) -> DataFrame:
    """The last check of the actions: ``facts`` (name, value) of the sub-audits must agree, and
    ledger, chain and bars must have a fingerprint. A figure that is absent fails."""
    spark = facts.sparkSession
    prints = spark.createDataFrame([(n,) for n in FINAL_PRINTS], "name string").join(facts, "name", "left")
    return gather(
        _pinned(facts, spark.createDataFrame(FINAL_PINS, "check string, name string, expected string")),
        unequal_pairs(facts, spark.createDataFrame(FINAL_PAIRS, "check string, left string, right string")),
        violations(prints.where(F.length(F.coalesce("value", F.lit(""))) == 0), "fingerprint missing", F.col("name")))


def final_fingerprint(facts: DataFrame) -> DataFrame:
    """One fingerprint of ledger, chain and the control's figures."""
    of = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(""))
    control = facts.where(F.col("name").startswith("control."))
    parts = beside(facts.agg(of("ledger.fingerprint").alias("a"), of("chain.fingerprint").alias("b")),
                   canonical_fingerprint(control).withColumnRenamed("fingerprint", "c"))
    return parts.select(F.sha2(F.concat_ws("\n", "a", "b", "c"), 256).alias("fingerprint"))


def freeze_gate(manifest: DataFrame, facts: DataFrame, gates: DataFrame, sums: DataFrame, files: DataFrame,
                pins: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether a frozen manifest says what the evidence says.

    ``manifest`` (name, value): its figures; those named ``basis.…`` are what ``fingerprint``
    covers, and ``basis.<gate>.fingerprint`` is a gate's. ``facts`` (name, value): figures
    computed from the data. ``gates`` (gate, pass, errors, fingerprint): the gates' evidence.
    ``sums`` and ``files`` (key, sha256): the registered and the actual digests; the key
    ``canonical`` stands for the fingerprint. ``pins`` (check, name, expected) must hold in manifest
    and facts; ``pairs`` (check, left, right) name figures of either that must be equal.
    """
    figures = manifest.unionByName(facts)
    basis = canonical_fingerprint(manifest.where(F.col("name").startswith("basis.")))
    said = manifest.where("name = 'fingerprint'").agg(F.max("value").alias("said"))
    canon = beside(basis, said)
    printed = gates.join(manifest.select(F.col("name").alias("_n"), F.col("value").alias("frozen")),
                         F.concat(F.lit("basis."), "gate", F.lit(".fingerprint")) == F.col("_n"), "left")
    actual = files.select("key", "sha256").unionByName(
        basis.select(F.lit("canonical").alias("key"), F.col("fingerprint").alias("sha256")))
    return gather(
        row_violations(gates, F.col("gate"), {
            "gate does not pass": F.col("pass"), "gate reports errors": F.col("errors") == 0}),
        row_violations(printed, F.col("gate"), {
            "gate fingerprint differs from the manifest": F.col("fingerprint") == F.col("frozen")}),
        violations(canon.where(~F.col("fingerprint").eqNullSafe(F.col("said"))), "canonical fingerprint differs",
                   F.lit("fingerprint")),
        digest_violations(sums, actual, "key"),
        violations(missing_keys(actual, sums, ["key"]), "file without registered digest", F.col("key")),
        _pinned(figures, pins), unequal_pairs(figures, pairs))
