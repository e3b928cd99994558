"""Every operator as a query over the star-schema tables.

Each query takes (session, table folder). Inputs are derived by ``sources.star``.
"""

from collections.abc import Callable
from datetime import datetime, timedelta
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.functions import catalog, formulas as f
from shelfwatch.functions.names import closing, lead_days
from shelfwatch.functions.numeric import round_half_up
from shelfwatch.operators import changes, criticality, quality, rolling, tails, usage
from shelfwatch.operators.joins import flag_keys, without_keys
from shelfwatch.operators.ordering import numbered
from shelfwatch.plans import history, latest, oplog, orders, retention
from shelfwatch.schema import ALERTS, DAY_KEY, LEDGER_COLUMNS, RUN_LOG, SERIES_KEY, SUMMARY
from shelfwatch.sources import ledger as ledger_files
from shelfwatch.sources import profiles, rules, star
from shelfwatch.staging import file_system, new_folder, staged
from shelfwatch.streaming import refresh, sessions
from shelfwatch.streaming.runs import RunLogListener

Query = Callable[[SparkSession, str], DataFrame]


def time_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- inputs --------------------------------------------------------------------


def _stock(spark: SparkSession, sf: str) -> DataFrame:
    return latest.stock_analytics(star.ledger(spark, sf), F.lit(None))


def _staged_stock(rows: DataFrame, as_of: Column) -> DataFrame:
    """The stock table as a stored table, as downstream tables would read it."""
    return staged(latest.stock_analytics(rows, as_of), "stock")


def _stored_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger as a stored table, for queries that read it more than once.

    Stored once per session and state of the tables: files that are written anew, or
    others, make it be derived again.
    """
    rows = star.ledger(spark, sf)
    made_from = tuple(_stamp(spark, name) for name in sorted(rows.inputFiles()))
    place = (spark.sparkContext.applicationId, sf)
    files, held = _stored.get(place, (None, None))
    if files != made_from or not _readable(held):
        held = staged(rows, "ledger")
        _stored[place] = (made_from, held)
    return held


_stored: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def _stamp(spark: SparkSession, name: str) -> tuple[str, int, int]:
    """A file's name, size and time of change."""
    system, place = file_system(spark, name)
    status = system.getFileStatus(place)
    return name, status.getLen(), status.getModificationTime()


def _readable(df: DataFrame) -> bool:
    system, place = file_system(df.sparkSession, df.inputFiles()[0])
    return system.exists(place)


def _ordered_today(spark: SparkSession, sf: str) -> DataFrame:
    """Series ordered on the newest order date, with the quantity; see FIXTURES.md.

    The date is found first, so only the lines of that day's orders are summed.
    """
    day = star.newest_order_date(spark, sf)
    rows = star.orders_tracking(spark, sf, F.col("o_orderdate").cast("date") == day)
    return staged(rows.groupBy(*SERIES_KEY).agg(F.sum("ordered_qty").alias("order_qty")), "ordered")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return usage.with_risk(_stored_ledger(spark, sf))


# --- sources and sinks -----------------------------------------------------------


def s_ledger(spark, sf):
    return star.ledger(spark, sf)


def s_fullload(spark, sf):
    path = new_folder(spark, "ledger")
    ledger_files.write_ledger(star.ledger(spark, sf), path)
    return ledger_files.read_ledger(spark, path)


def _csv_of(spark, rows: DataFrame) -> str:
    path = new_folder(spark, "upload")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


def s_csv(spark, sf):
    """Ledger written as CSV and read back as text cells, then typed."""
    return ledger_files.to_ledger(ledger_files.read_ledger_csv(spark, _csv_of(spark, star.ledger(spark, sf))))


def s_normcols(spark, sf):
    """The same with a header in capitals and with blanks."""
    rows = star.ledger(spark, sf)
    shouted = rows.toDF(*[f" {c.upper()} " for c in rows.columns])
    return ledger_files.to_ledger(ledger_files.read_ledger_csv(spark, _csv_of(spark, shouted)))


def _faulty_upload(spark, sf) -> str:
    """CSV lines of a faulty upload; some have a cell too few or too many."""
    cells = star.ledger_text(star.ledger(spark, sf))
    names = LEDGER_COLUMNS
    quoted = [F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit('"'), F.col(c), F.lit('"'))) for c in names]
    line = F.concat_ws(",", *quoted)
    stock = F.try_to_number(F.col("closing_stock"), F.lit("999999999999"))
    line = F.when(stock % 89 == 3, F.concat_ws(",", *quoted[:-1])).when(stock % 83 == 2, F.concat(line, F.lit(",more"))).otherwise(line)
    path = new_folder(spark, "upload")
    parts = cells.select(line.alias("value"))
    parts.write.text(f"{path}/lines")
    # every part needs the header line
    spark.read.text(f"{path}/lines", wholetext=True).select(
        F.concat(F.lit(",".join(names) + "\n"), F.col("value")).alias("value")
    ).write.text(f"{path}/files")
    return f"{path}/files"


def _load_faulty(spark, sf) -> tuple[str, ledger_files.LoadResult]:
    path = new_folder(spark, "ledger")
    return path, ledger_files.load_ledger_csv(spark, _faulty_upload(spark, sf), path, on_error="continue")


def s_badrows(spark, sf):
    """A faulty upload loaded with ``on_error="continue"``: the rows that stay."""
    path, _ = _load_faulty(spark, sf)
    return ledger_files.read_ledger(spark, path)


def s_rejected(spark, sf):
    """The rows of the same upload that were set aside, counted by what they have."""
    _, result = _load_faulty(spark, sf)
    rows = spark.read.parquet(result.rejected_path)
    bad = F.col(quality.CORRUPT).isNotNull()
    return rows.groupBy(bad.alias("bad_line")).agg(F.count(F.lit(1)).alias("rows"))


def s_profile_rejected(spark, sf):
    """Profiles that are not complete, with the reason."""
    saved = _saved_profiles(spark, sf)
    return profiles.rejected_profiles(saved, F.lit("2001-01-01 00:00:00")).select("organization", "reason")


def _rule_path(spark, sf) -> str:
    path = new_folder(spark, "rules")
    star.rule_file(spark, sf).write.json(path)
    return path


def s_rules(spark, sf):
    """Criticality of every row by rules read from a JSON file with hundreds of patterns."""
    found = staged(rules.read_rule_rows(spark, _rule_path(spark, sf)), "rules")
    rows = criticality.with_criticality(_stored_ledger(spark, sf), found, star.STAR_DEFAULT_SCORE)
    return rows.select(*DAY_KEY, "criticality")


def s_rules_rejected(spark, sf):
    """The rules of the file whose scores are out of bounds."""
    return rules.rejected_rules(rules.read_rule_file(spark, _rule_path(spark, sf)))


def s_profile(spark, sf):
    """Latest stock with the profile of its organization."""
    complete = profiles.complete_profiles(_saved_profiles(spark, sf), F.lit("2001-01-01 00:00:00"))
    rows = profiles.with_profile(_stock(spark, sf), complete)
    return rows.select(*SERIES_KEY, "closing_stock", F.coalesce("sector", F.lit("")).alias("sector"),
                       F.coalesce("region", F.lit("")).alias("region"))


def _saved_profiles(spark, sf) -> DataFrame:
    region = star.table(spark, sf, "region")
    sector = F.element_at(F.array(*[F.lit(s) for s in V.SECTORS]), F.col("r_regionkey") + 1)
    return region.select(
        F.col("r_name").alias("organization"),
        sector.alias("sector"),
        F.concat(F.lit("Region "), "r_regionkey").alias("region"),
        F.when(F.col("r_regionkey") != 3, "Parts").otherwise("").alias("goods_type"),
    )


def s_export(spark, sf):
    rows = history.score_rows(history.alerts(_stored_ledger(spark, sf), ordered=False), star.star_rules())
    return orders.action_table(rows, V.TOP_ACTIONS)


# --- row formulas ------------------------------------------------------------------


def p_slice(spark, sf):
    chosen = usage.slice_ledger(star.ledger(spark, sf), organization="ASIA", location="All", item="PROMO")
    chosen = staged(chosen, "slice")
    return usage.with_average_usage(chosen).select(
        *DAY_KEY, "closing_stock", round_half_up(F.col("avg_usage"), 4).alias("avg_usage")
    )


def p_daysleft(spark, sf):
    return _judged(spark, sf).select(*DAY_KEY, round_half_up(F.col("days"), 4).alias("days_left"))


def p_risk(spark, sf):
    return _judged(spark, sf).select(*DAY_KEY, "risk_status")


def p_urg3(spark, sf):
    return _judged(spark, sf).select(*DAY_KEY, f.urgency3(F.col("days"), lead_days()).alias("urgency_level"))


def p_urg4(spark, sf):
    return latest.classify_reorders(_stock(spark, sf)).select(*SERIES_KEY, "days_left", "urgency_level")


def p_reorder(spark, sf):
    quantity = f.reorder_qty(lead_days(), F.col("avg_usage"), closing())
    return usage.with_average_usage(_stored_ledger(spark, sf)).select(
        *DAY_KEY, round_half_up(quantity, 4).alias("reorder_qty")
    )


def p_safety(spark, sf):
    return latest.classify_reorders(_stock(spark, sf)).select(
        *SERIES_KEY, "reorder_qty", "reorder_qty_with_safety"
    )


def p_score(spark, sf):
    return latest.classify_reorders(_stock(spark, sf)).select(*SERIES_KEY, "priority_score")


def p_crit(spark, sf):
    rules = star.star_rule_rows(spark)
    rows = criticality.with_criticality(_stored_ledger(spark, sf), rules, star.STAR_DEFAULT_SCORE)
    return rows.select(*DAY_KEY, "criticality")


def p_scorec(spark, sf):
    return history.score_rows(_stock(spark, sf), star.star_rules()).select(*SERIES_KEY, "priority_score")


def p_explain(spark, sf):
    rows = _stock(spark, sf).filter(F.col("risk_status") == "HIGH")
    return history.explain_rows(rows).select(*SERIES_KEY, "explanation")


def p_action(spark, sf):
    sentence = history.action_sentence(F.col("item"), F.col("organization"), F.col("location"))
    return _stock(spark, sf).filter(F.col("risk_status") == "HIGH").select(*SERIES_KEY, sentence.alias("action"))


def _calculator(spark, sf):
    return history.calculator_rows(_stored_ledger(spark, sf), ordered=False)


def p_whatif(spark, sf):
    """Orders of the newest day, a hundredfold, projected on the latest stock; others get the default."""
    wanted = _ordered_today(spark, sf).withColumn("order_qty", F.col("order_qty") * 100)
    return orders.what_if(_stock(spark, sf), wanted).select(
        *SERIES_KEY, "order_qty", "qty_out_of_range", "projected_stock", "current_days", "projected_days", "days_gained"
    )


def p_cover(spark, sf):
    """Default orders at a thousandfold usage, where they exceed every input range."""
    busy = _calculator(spark, sf).withColumn("avg_daily_usage", F.col("avg_daily_usage") * 1000)
    return orders.what_if(busy).select(
        *SERIES_KEY, "closing_stock", "order_qty", "projected_days", "cover_level"
    )


def p_target(spark, sf):
    rows = orders.with_coverage(_calculator(spark, sf))
    return rows.select(*SERIES_KEY, "closing_stock", *[f"qty_{n}_days" for n in V.COVERAGE_DAYS])


def _usage(spark, sf):
    return latest.usage_stats(star.ledger(spark, sf), F.lit(None))


def p_trend(spark, sf):
    return _usage(spark, sf).select(*SERIES_KEY, "trend_direction")


def p_cv(spark, sf):
    return _usage(spark, sf).select(*SERIES_KEY, "usage_volatility_pct")


def p_pattern(spark, sf):
    """Demand pattern of a smoother ledger, where all three levels occur."""
    smooth = star.ledger(spark, sf).withColumn("issued", F.col("issued") + 40)
    return latest.usage_stats(smooth, F.lit(None)).select(*SERIES_KEY, "usage_volatility_pct", "demand_pattern")


def p_alerttype(spark, sf):
    return latest.alert_candidates(_stock(spark, sf), None, F.lit("2001-12-01")).select(
        *SERIES_KEY, "alert_type", "days_left"
    )


# --- joins ---------------------------------------------------------------------------


def j_latest(spark, sf):
    return history.latest_snapshot(_stored_ledger(spark, sf))


def j_enrich(spark, sf):
    stock = staged(_stock(spark, sf), "stock")
    rows = latest.stock_with_recommendations(stock, latest.reorder_recommendations(stock))
    return rows.select(
        *SERIES_KEY, "closing_stock", "reorder_qty", F.coalesce("urgency_level", F.lit("")).alias("urgency_level")
    )


def _two_versions(spark, sf) -> tuple[DataFrame, DataFrame, Column]:
    rows = _stored_ledger(spark, sf)
    previous, current = star.ledger_versions(rows)
    return previous, current, rows.agg(F.max("date")).scalar()


def _second_alert_run(spark, sf, dedupe: str) -> DataFrame:
    """Alerts of the current ledger version, after the previous one alerted that day."""
    previous, current, as_of = _two_versions(spark, sf)
    old, new = latest.stock_analytics(previous, as_of), latest.stock_analytics(current, as_of)
    return latest.new_alerts(new, None, latest.alert_candidates(old, None, as_of), as_of, dedupe)


def j_notalerted(spark, sf):
    return _second_alert_run(spark, sf, "literal").drop("alert_date")


def t_alerts(spark, sf):
    return _second_alert_run(spark, sf, "all")


def j_unordered(spark, sf):
    return without_keys(_stock(spark, sf), _ordered_today(spark, sf), SERIES_KEY).select(*SERIES_KEY, "closing_stock")


def j_ordered(spark, sf):
    return flag_keys(_stock(spark, sf), _ordered_today(spark, sf), SERIES_KEY, "ordered").select(
        *SERIES_KEY, "closing_stock", "ordered"
    )


def j_ordered_list(spark, sf):
    return history.ordered_alerts(_stored_ledger(spark, sf), star.star_rules(), _ordered_today(spark, sf))


def j_diff(spark, sf):
    previous, current, _ = _two_versions(spark, sf)
    return changes.row_changes(previous, current, DAY_KEY)


def _by_month(rows: DataFrame) -> DataFrame:
    """A ledger version that repeats its keys: days become the first of their month."""
    return rows.withColumn("date", F.trunc("date", "month"))


def j_diff_repeated(spark, sf):
    """Row changes of versions in which a key has many rows."""
    previous, current, _ = _two_versions(spark, sf)
    return changes.row_changes(_by_month(previous), _by_month(current), DAY_KEY)


# --- aggregations ----------------------------------------------------------------------


def q_overview(spark, sf):
    return history.overview(_stored_ledger(spark, sf))


def q_high_series(spark, sf):
    return history.high_risk_series(_stored_ledger(spark, sf))


def a_heat(spark, sf):
    return history.stock_heat(star.ledger(spark, sf))


def a_pivot(spark, sf):
    # locations are the nations, a small dimension that names the columns
    names = [r[0] for r in star.table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]
    return history.stock_grid(history.stock_heat(star.ledger(spark, sf)), names)


def a_urgsum(spark, sf):
    return history.urgency_summary(history.reorder_list(_stored_ledger(spark, sf), ordered=False))


def a_summary(spark, sf):
    figures = staged(tails.tail_figures(star.ledger(spark, sf)), "figures")
    as_of = latest.newest_date(figures)
    return latest.summary_of_stock(latest.stock_from_tails(figures, as_of), as_of)


def _with_clock(rows: DataFrame, column: str) -> tuple[DataFrame, Column]:
    return rows, oplog.newest(rows, column)


def a_runperf(spark, sf):
    rows = oplog.run_performance(*_with_clock(star.runs(spark, sf), "execution_time"))
    return rows.withColumn("avg_duration", round_half_up(F.col("avg_duration"), 4))


def a_runrate(spark, sf):
    return oplog.run_rates(*_with_clock(star.runs(spark, sf), "execution_time"))


def a_actstats(spark, sf):
    rows = oplog.action_stats(*_with_clock(star.actions(spark, sf), "action_timestamp"))
    return rows.withColumn("avg_response_ms", round_half_up(F.col("avg_response_ms"), 4))


def a_actusers(spark, sf):
    return oplog.action_users(*_with_clock(star.actions(spark, sf), "action_timestamp"))


def a_resp(spark, sf):
    rows = oplog.response_times(*_with_clock(star.actions(spark, sf), "action_timestamp"))
    return rows.withColumn("avg_response_ms", round_half_up(F.col("avg_response_ms"), 4))


def a_avguse(spark, sf):
    rows = usage.plain_average(star.ledger(spark, sf))
    return rows.withColumn("avg_daily_usage", round_half_up(F.col("avg_daily_usage"), 4))


def a_maxid(spark, sf):
    return oplog.highest_id(star.actions(spark, sf), "action_id")


def a_pending(spark, sf):
    previous, current, _ = _two_versions(spark, sf)
    return changes.pending_changes(changes.row_changes(previous, current, DAY_KEY))


# --- windows -------------------------------------------------------------------------------


def w_avgall(spark, sf):
    rows = usage.with_average_usage(_stored_ledger(spark, sf))
    return rows.select(*DAY_KEY, round_half_up(F.col("avg_usage"), 4).alias("avg_usage"))


def _rolling(spark, sf, **columns: Column) -> DataFrame:
    rows = rolling.rolling_figures(_stored_ledger(spark, sf))
    return rows.select(*DAY_KEY, *[c.alias(name) for name, c in columns.items()])


def w_avg7(spark, sf):
    return _rolling(spark, sf, avg_7=round_half_up(F.col("avg_short"), 4))


def w_avg30(spark, sf):
    return _rolling(spark, sf, avg_30=round_half_up(F.col("avg_long"), 4))


def w_minmax7(spark, sf):
    return _rolling(spark, sf, min_7=F.col("min_short"), max_7=F.col("max_short"))


def w_std7(spark, sf):
    return _rolling(spark, sf, std_7=round_half_up(F.col("stddev_short"), 4))


def w_recent(spark, sf):
    return tails.latest_rows(star.ledger(spark, sf), 1).select(*LEDGER_COLUMNS)


# --- composite queries -----------------------------------------------------------------------


def q_alerts(spark, sf):
    return history.alerts(_stored_ledger(spark, sf))


def q_alerts_page(spark, sf):
    return history.scored_alerts(_stored_ledger(spark, sf), star.star_rules(), _ordered_today(spark, sf))


def q_reorder(spark, sf):
    return history.reorder_list(_stored_ledger(spark, sf))


def q_actions(spark, sf):
    return history.top_actions(_stored_ledger(spark, sf), star.star_rules(), _ordered_today(spark, sf))


def q_calc(spark, sf):
    return history.calculator_rows(_stored_ledger(spark, sf))


def m_stock(spark, sf):
    rows = latest.stock_analytics(star.ledger(spark, sf))
    return rows.withColumn("last_updated", F.col("last_updated").cast("date"))


def m_reorder(spark, sf):
    return latest.sorted_recommendations(latest.reorder_recommendations(_stock(spark, sf))).drop("last_updated")


def m_usage(spark, sf):
    return _usage(spark, sf).drop("last_updated")


def q_risktop(spark, sf):
    return latest.riskiest(_stock(spark, sf))


def q_rectop(spark, sf):
    return latest.top_recommendations(latest.reorder_recommendations(_stock(spark, sf)))


def q_rising(spark, sf):
    return latest.rising_usage(_usage(spark, sf))


# --- sorts and limits --------------------------------------------------------------------------


def o_sort(spark, sf):
    """The reorder list, most urgent first, with the place of each row in that order."""
    rows = history.reorder_list(_stored_ledger(spark, sf), ordered=False)
    order = ["days_left", *SERIES_KEY, "closing_stock", "reorder_qty"]
    return numbered(rows, [f.urgency_rank(F.col("urgency_level")), *[F.col(c) for c in order]], "place")


def o_topk(spark, sf):
    rows = history.score_rows(history.alerts(_stored_ledger(spark, sf), ordered=False), star.star_rules())
    return history.top_rows(rows, V.TOP_ALERTS)


def o_preview(spark, sf):
    return history.preview(star.ledger(spark, sf))


def o_last7(spark, sf):
    rows = tails.stock_points(star.ledger(spark, sf))
    return rows.select(
        *SERIES_KEY,
        F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"),
        F.array_join(F.transform("closing_stocks", lambda s: s.cast("string")), ",").alias("closing_stocks"),
    )


def o_distinct(spark, sf):
    return history.name_lists(star.ledger(spark, sf), SERIES_KEY)


def o_logtail(spark, sf):
    rows = oplog.log_tail(star.runs(spark, sf), "execution_time", "log_id", status="FAILED")
    return rows.withColumn("execution_time", time_text(F.col("execution_time")))


# --- data quality --------------------------------------------------------------------------------


def _findings(spark, sf, *rules: str) -> DataFrame:
    found = quality.find_problems(star.ledger_text(star.ledger(spark, sf)))
    return found.filter(F.col("rule").isin(*rules)) if rules else found


def v_date(spark, sf):
    return _findings(spark, sf, "bad_date")


def v_num(spark, sf):
    return _findings(spark, sf, "not_numeric")


def v_neg(spark, sf):
    return _findings(spark, sf, "negative")


def v_formula(spark, sf):
    return _findings(spark, sf, "closing_mismatch")


def v_blank(spark, sf):
    return _findings(spark, sf, "empty_name")


def v_report(spark, sf):
    return _findings(spark, sf)


def v_negclose(spark, sf):
    """Rows whose stock, less what is on order for the day, would be negative."""
    rows = star.ledger(spark, sf).withColumn("closing_stock", closing() - F.col("issued"))
    return quality.negative_closing(rows)


def v_parity(spark, sf):
    """Latest stock against the same table of the ledger's newer version."""
    previous, current, as_of = _two_versions(spark, sf)
    return quality.compare_results(
        latest.stock_analytics(previous, as_of),
        latest.stock_analytics(current, as_of),
        SERIES_KEY,
        ["closing_stock", "avg_daily_usage", "days_left"],
    )


def v_parity_repeated(spark, sf):
    """Two ledger versions by month, where a key has many rows: their quantities matched as bags."""
    previous, current, _ = _two_versions(spark, sf)
    months = [_by_month(rows).select(*DAY_KEY, "issued", "closing_stock") for rows in (previous, current)]
    return quality.compare_results(*months, DAY_KEY, ["issued", "closing_stock"])


def v_cols(spark, sf):
    """An upload that lacks the columns which are empty in some row of the faulty one, with its missing columns."""
    rows = star.ledger_text(star.ledger(spark, sf))
    gaps = rows.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in LEDGER_COLUMNS]).first().asDict()
    return quality.shape_problems(rows.drop(*[c for c, has in gaps.items() if has]))


def v_empty(spark, sf):
    """An upload cut down to days that the ledger does not have: a header and no row."""
    rows = star.ledger_text(star.ledger(spark, sf)).filter(F.col("date") > F.lit("9999"))
    return quality.shape_problems(rows)


# --- operational tables ------------------------------------------------------------------------------


def l_recent(spark, sf):
    rows = oplog.recent_actions(*_with_clock(star.actions(spark, sf), "action_timestamp"))
    return rows.withColumn("action_timestamp", time_text(F.col("action_timestamp")))


def _closed_sessions(spark, sf) -> DataFrame:
    """Sessions, closed by their last configuration change."""
    log = star.actions(spark, sf)
    closings = log.filter(F.col("action_type") == "CONFIG_CHANGED").select(
        "session_id", F.col("action_timestamp").alias("closed_at")
    )
    return oplog.close_sessions(oplog.sessions(log), closings)


def _session_text(rows: DataFrame) -> DataFrame:
    times = {c: time_text(F.col(c)) for c in ("session_start", "last_activity") if c in rows.columns}
    return rows.withColumns(times).withColumn("pages_visited", F.array_join("pages_visited", ","))


def l_sessions(spark, sf):
    return _session_text(oplog.sessions(star.actions(spark, sf)))


def l_close(spark, sf):
    rows = _closed_sessions(spark, sf).filter(~F.col("is_active"))
    return rows.select(
        "session_id", time_text(F.col("session_end")).alias("session_end"), "is_active", "session_duration_minutes"
    )


def l_active(spark, sf):
    log = star.actions(spark, sf)
    return _session_text(oplog.active_sessions(_closed_sessions(spark, sf), oplog.newest(log, "action_timestamp")))


def l_pending(spark, sf):
    """Open orders; the state is filtered before the lines are summed."""
    as_of = star.newest_order_date(spark, sf)
    return oplog.pending_orders(star.orders_tracking(spark, sf, F.col("o_orderstatus").isin("O", "P")), as_of)


def _placed(spark, sf) -> tuple[DataFrame, DataFrame]:
    requests = star.orders_tracking(spark, sf).select(
        "order_id",
        *SERIES_KEY,
        "ordered_qty",
        F.concat(F.lit("user_"), F.col("order_id").cast("string")).alias("user_name"),
        F.col("priority_level").alias("priority"),
    )
    return oplog.place_orders(requests, F.lit("2001-12-01 08:30:00"))


def l_orders(spark, sf):
    """Orders appended to the order table and read back."""
    rows, _ = _placed(spark, sf)
    path = new_folder(spark, "orders")
    oplog.append_orders(rows, path)
    return oplog.read_orders(spark, path).select(
        "order_id", *SERIES_KEY, "order_date", time_text(F.col("order_timestamp")).alias("order_timestamp"), "ordered_by",
        "ordered_qty", "status", "priority_level", time_text(F.col("created_at")).alias("created_at"),
    )


def l_equal_orders(spark, sf):
    """Every request sent twice without an id: as many ids as rows, and the same ids on a replay."""
    asked = star.orders_tracking(spark, sf).select(
        *SERIES_KEY, "ordered_qty", F.lit("ann").alias("user_name"), F.col("priority_level").alias("priority")
    )
    twice = asked.unionByName(asked)
    first, _ = oplog.place_orders(twice, F.lit("2001-12-01 08:30:00"))
    again, _ = oplog.place_orders(twice, F.lit("2001-12-01 08:30:00"))
    ids = first.select("order_id", F.lit(1).alias("run")).unionByName(again.select("order_id", F.lit(2).alias("run")))
    each = ids.groupBy("order_id").agg(F.count_if(F.col("run") == 1).alias("first"), F.count_if(F.col("run") == 2).alias("again"))
    return each.agg(
        F.sum("first").alias("orders"), F.count(F.lit(1)).alias("ids"),
        F.count_if(F.col("first") == F.col("again")).alias("replayed"),
    )


def l_order_actions(spark, sf):
    _, rows = _placed(spark, sf)
    return rows


def l_actions(spark, sf):
    """Order log rows appended to an action table and read back."""
    _, rows = _placed(spark, sf)
    path = new_folder(spark, "actions")
    oplog.append_actions(rows, path, F.lit("2001-12-01 08:30:00"))
    return spark.read.parquet(path).select(
        "action_type", "user_name", *SERIES_KEY, "action_details", "source_page", "status"
    )


def l_details(spark, sf):
    """A value of every action's JSON details."""
    return star.actions(spark, sf).select("action_id", "action_type", oplog.detail("k", "bigint").alias("k"))


def l_runhist(spark, sf):
    log = star.runs(spark, sf)
    rows = oplog.run_history(log, "TASK_VIEW", oplog.newest(log, "execution_time"))
    return rows.withColumn("execution_time", time_text(F.col("execution_time"))).withColumn(
        "error_message", F.coalesce("error_message", F.lit(""))
    )


def l_fresh(spark, sf):
    rows = oplog.last_refreshes(star.runs(spark, sf))
    return rows.withColumns(
        {c: time_text(F.col(c)) for c in ("last_refresh_start", "last_refresh_end")}
    )


def l_health(spark, sf):
    previous, current, as_of = _two_versions(spark, sf)
    old, new = (latest.stock_analytics(v, as_of).drop("last_updated") for v in (previous, current))
    feeds = {
        "ledger_changes": changes.row_changes(previous, current, DAY_KEY),
        "stock_changes": changes.row_changes(old, new, SERIES_KEY),
    }
    return oplog.system_health(star.runs(spark, sf), feeds, ["TASK_CLICK", "TASK_VIEW"])


# --- the same in SQL, by the functions of the session catalog ---------------------------------------------------


def sql_reorders(spark, sf):
    """Recommendations, written in SQL over the stock table alone."""
    catalog.register_formulas(spark)
    _stock(spark, sf).createOrReplaceTempView("latest_stock")
    return spark.sql(
        """SELECT organization, location, item, closing_stock, avg_daily_usage, days_left, lead_time_days,
                  reorder_qty_latest(lead_time_days, avg_daily_usage, closing_stock) AS reorder_qty,
                  reorder_qty_with_safety(lead_time_days, avg_daily_usage, closing_stock) AS reorder_qty_with_safety,
                  urgency4(days_left, lead_time_days) AS urgency_level,
                  priority_score(lead_time_days, avg_daily_usage, closing_stock) AS priority_score
             FROM latest_stock
            WHERE reorder_qty_latest(lead_time_days, avg_daily_usage, closing_stock) > 0"""
    )


def sql_history(spark, sf):
    """Run history of one task by a SQL table function."""
    catalog.register_run_lookups(spark, star.runs(spark, sf))
    return spark.sql(
        """SELECT log_id, task_name, date_format(execution_time, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS execution_time, status,
                  records_processed, coalesce(error_message, '') AS error_message, execution_duration_seconds
             FROM task_history('TASK_VIEW', (SELECT max(execution_time) FROM task_runs))"""
    )


def sql_status(spark, sf):
    """Newest run of every task by a SQL table function."""
    catalog.register_run_lookups(spark, star.runs(spark, sf))
    return spark.sql(
        """SELECT task_name, state, date_format(last_refresh_start, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS last_refresh_start,
                  date_format(last_refresh_end, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS last_refresh_end
             FROM refresh_status()"""
    )


# --- change feeds, retention and streams ------------------------------------------------------------------


def t_cdc(spark, sf):
    previous, current, _ = _two_versions(spark, sf)
    return changes.change_feed(previous, current, DAY_KEY)


def t_cdc_leaves(spark, sf):
    """Changes of a ledger of which one month was restated; only its leaves that differ are compared row by row."""
    rows = _stored_ledger(spark, sf)
    restated = (F.trunc("date", "month") == F.lit("1998-03-01").cast("date")) & (F.col("closing_stock") % 53 == 0)
    current = rows.withColumn("issued", F.col("issued") + F.when(restated, 1).otherwise(0))
    return changes.changes_by_leaves(rows, current, DAY_KEY, F.trunc("date", "month"), SERIES_KEY)


def t_acdc(spark, sf):
    previous, current, as_of = _two_versions(spark, sf)
    old, new = (latest.stock_analytics(v, as_of).drop("last_updated") for v in (previous, current))
    rows = changes.row_changes(old, new, SERIES_KEY)
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("old_risk_status", "new_risk_status")})


def t_recompute(spark, sf):
    """The stock table after restated history: only changed series are recomputed."""
    previous, current, _ = _two_versions(spark, sf)
    as_of = previous.agg(F.max("date")).first()[0]
    moved = changes.change_feed(previous, current, DAY_KEY)
    stock = _staged_stock(previous, F.lit(as_of))
    return refresh.recompute_series(current, moved, stock, as_of).drop("last_updated")


def t_retain(spark, sf):
    rows = _stored_ledger(spark, sf)
    return retention.retain(rows, "date", V.KEEP_ALERTS_DAYS, oplog.newest(rows, "date"))


def t_expired(spark, sf):
    """Ledger days past each kind's limit, counted in one pass."""
    rows = staged(star.ledger(spark, sf).select("date"), "days")
    return retention.expired_by_kind(rows, "date", oplog.newest(rows, "date"))


def t_retain_tables(spark, sf):
    """Alerts of the streamed refresh after the retention ran on its tables, so long after that only the last batch's stay."""
    tables, _ = _streamed(spark, sf)
    kept = tables.alerts(spark)
    days = [r[0] for r in kept.select("alert_date").distinct().orderBy("alert_date").collect()]  # one per batch at most
    as_of = datetime.combine(days[-1], datetime.min.time()) + timedelta(days=V.KEEP_ALERTS_DAYS)
    retention.expire_tables(spark, tables.root, {"summaries": SUMMARY, "alerts": ALERTS, "runs": RUN_LOG}, as_of)
    return tables.alerts(spark).groupBy("alert_date").agg(F.count(F.lit(1)).alias("alerts"))


BATCHES = 4
FILES = 4


def _streamed(spark, sf) -> tuple[refresh.RefreshTables, int]:
    """Run the refresh over the ledger, which arrives in four batches in time order.

    A batch is FILES files; batch ``n`` holds the days up to the ``n``-th quarter of the
    period, so its summary and alerts are those of a known part of the ledger. By the
    clock a batch comes every REFRESH_MINUTES, so the tables with longer lags skip some;
    they catch up at the end.
    """
    path = new_folder(spark, "arrivals")
    rows = _stored_ledger(spark, sf).withColumn("batch", _quarter())
    for n in range(BATCHES):
        rows.filter(F.col("batch") == n).drop("batch").repartition(FILES).write.mode("append").parquet(path)
    root = new_folder(spark, "refresh")
    stream = refresh.ledger_stream(spark, path, files_per_batch=FILES)
    ticks = count(step=60 * V.REFRESH_MINUTES)
    query = refresh.start_refresh(
        stream, root, new_folder(spark, "checkpoint"), once=True, buckets=8, lags=V.TABLE_LAGS, clock=lambda: next(ticks)
    )
    query.awaitTermination()
    tables, batch = refresh.RefreshTables(root, 8), refresh.last_batch(query)
    refresh.catch_up(spark, tables, batch)
    return tables, batch


def _quarter() -> Column:
    """Arrival batch of a ledger row, by year."""
    return F.least(F.lit(BATCHES - 1), F.greatest(F.lit(0), F.year("date") - 1998)).cast("int")


def t_refresh(spark, sf):
    tables, batch = _streamed(spark, sf)
    return tables.stock(spark, batch).withColumn("last_updated", F.col("last_updated").cast("date"))


def t_reorder(spark, sf):
    """Recommendations of the streamed refresh."""
    tables, batch = _streamed(spark, sf)
    return tables.recommendations(spark, batch).drop("last_updated")


def t_usage(spark, sf):
    """Usage statistics of the streamed refresh."""
    tables, batch = _streamed(spark, sf)
    return tables.usage(spark, batch).drop("last_updated")


def t_summary(spark, sf):
    """All summary rows of the streamed refresh."""
    tables, _ = _streamed(spark, sf)
    return tables.summaries(spark).drop("created_at")


def t_alert_log(spark, sf):
    """All alerts of the streamed refresh."""
    tables, _ = _streamed(spark, sf)
    return tables.alerts(spark).drop("alert_id", "created_at")


def t_runs(spark, sf):
    """Runs of the streamed refresh; the alerts run only where the stock changed."""
    tables, _ = _streamed(spark, sf)
    rows = tables.runs(spark)
    return rows.groupBy("task_name", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("records_processed").alias("records_processed")
    )


def l_runlog(spark, sf):
    """Runs of a stream over the action log as its listener writes them; each file is a run."""
    log = star.actions(spark, sf)
    source, path = new_folder(spark, "arrivals"), new_folder(spark, "runs")
    log.repartition(BATCHES, F.xxhash64("action_id")).write.parquet(source)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with RunLogListener(spark, path) as runs:
        writer = arriving.writeStream.queryName("keep_actions").option("checkpointLocation", new_folder(spark, "checkpoint"))
        query = writer.trigger(availableNow=True).start(new_folder(spark, "actions"), format="parquet")
        runs.wait(query)
    rows = spark.read.schema(RUN_LOG).parquet(path)
    good = (F.col("execution_duration_seconds") > 0) & F.col("log_id").isNotNull()
    return rows.groupBy("task_name", "status").agg(
        F.sum("records_processed").alias("records_processed"), F.count_if(~good).alias("incomplete")
    )


def _streamed_sessions(spark, sf, **how) -> tuple[DataFrame, DataFrame]:
    """The action log, and its sessions by a stream whose files arrive out of time order, in four batches or more."""
    log = star.actions(spark, sf)
    source = new_folder(spark, "arrivals")
    log.repartition(BATCHES, F.xxhash64("action_id")).write.parquet(source)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = new_folder(spark, "sessions")
    query = sessions.start_sessions(arriving, out, new_folder(spark, "checkpoint"), once=True, **how)
    query.awaitTermination()
    return log, sessions.SessionsTable(out).read(spark, refresh.last_batch(query))


def t_sessions(spark, sf):
    """Sessions split where nothing happens for half an hour."""
    log, rows = _streamed_sessions(spark, sf)
    rows = sessions.open_sessions(rows.drop("session_end"), oplog.newest(log, "action_timestamp"))
    return rows.withColumns({c: time_text(F.col(c)) for c in ("session_start", "last_activity")})


def t_closed(spark, sf):
    """Sessions closed in the stream by their last configuration change; an id is one session."""
    _, rows = _streamed_sessions(spark, sf, gap="2 days", closing="CONFIG_CHANGED")
    return sessions.closed_sessions(rows).select(
        "session_id", time_text(F.col("session_end")).alias("session_end"), "is_active", "session_duration_minutes"
    )


QUERIES: dict[str, Query] = {
    fn.__name__: fn
    for fn in [
        s_ledger, s_fullload, s_csv, s_normcols, s_badrows, s_rejected, s_profile, s_profile_rejected, s_rules,
        s_rules_rejected, s_export,
        p_slice, p_daysleft, p_risk, p_urg3, p_urg4, p_reorder, p_safety, p_score, p_crit, p_scorec,
        p_explain, p_action, p_whatif, p_cover, p_target, p_trend, p_cv, p_pattern, p_alerttype,
        j_latest, j_enrich, j_notalerted, j_unordered, j_ordered, j_ordered_list, j_diff, j_diff_repeated,
        q_overview, q_high_series, a_heat, a_pivot, a_urgsum, a_summary, a_runperf, a_runrate, a_actstats,
        a_actusers, a_resp, a_avguse, a_maxid, a_pending,
        w_avgall, w_avg7, w_avg30, w_minmax7, w_std7, w_recent,
        q_alerts, q_alerts_page, q_reorder, q_actions, q_calc, m_stock, m_reorder, m_usage,
        q_risktop, q_rectop, q_rising,
        o_sort, o_topk, o_preview, o_last7, o_distinct, o_logtail,
        v_date, v_num, v_neg, v_formula, v_blank, v_report, v_negclose, v_parity, v_parity_repeated, v_cols, v_empty,
        l_recent, l_sessions, l_close, l_active, l_pending, l_orders, l_equal_orders, l_order_actions, l_actions, l_details,
        l_runhist, l_fresh, l_health, sql_reorders, sql_history, sql_status,
        t_cdc, t_cdc_leaves, t_acdc, t_recompute, t_alerts, t_retain, t_expired, t_retain_tables, t_refresh, t_reorder, t_usage,
        t_summary, t_alert_log, t_runs, t_sessions, t_closed, l_runlog,
    ]
}
