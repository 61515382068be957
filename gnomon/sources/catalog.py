"""The warehouse: schemas, views, introspection, and a guard for ad-hoc SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import temporal

_KEYS = "hist_id timestamp, base_id long, bpk string"

#: Column lists of the warehouse's tables (fixed values).
TABLES: dict[str, str] = {
    "dim_security": f"{_KEYS}, sec_type string, ticker string, isin string, cusip string, sedol string, figi string, name string, currency string, exchange string, sector string, industry string, country string, status string, created_by string",
    "dim_security_identifier_audit": "audit_id long, base_id long, field string, old_value string, new_value string, source string, changed_at timestamp",
    "dim_security_exchange": f"{_KEYS}, exchange string, ticker string, is_primary boolean",
    "dim_calendar": "calendar_date date, exchange_code string, year int, quarter int, month int, day_of_week int, day_name string, is_business_day boolean, is_holiday boolean, holiday_name string",
    "dim_classification_core": f"{_KEYS}, asset_class string, asset_type string, region string",
    "dim_classification_external": f"{_KEYS}, scheme string, code string, label string",
    "dim_classification_mapping": "mapping_id long, scheme string, code string, asset_class string, asset_type string, version int",
    "conflict_queue": "conflict_id long, base_id long, field string, existing string, incoming string, source string, status string",
    "fact_model_definition": f"{_KEYS}, name string, type string, version string, signal struct<name:string,params:map<string,double>>, sizing struct<name:string,params:map<string,double>>, universe struct<tickers:array<string>,filters:struct<min_price:double,min_volume:double>>, config_json string",
    "fact_backtest_run": f"{_KEYS}, model string, run_mode string, start_date date, end_date date, results struct<total_return:double,annualized_return:double,sharpe:double,sortino:double,max_drawdown:double,max_drawdown_duration:long,win_rate:double,profit_factor:double,total_trades:long,avg_trade_return:double,avg_holding:double,calmar:double,volatility:double>, params string, duration double, bar_count long, engine string",
    "fact_log": "log_id long, ts timestamp, level int, message string, tags array<string>, context string",
    "fact_data_quality": "batch_id string, source string, received long, rejected long, quality_score double, checks struct<nulls:long,outliers:long,future:long>",
    "fact_price_daily": f"{_KEYS}, security_base_id long, trade_date date, open double, high double, low double, close double, adj_close double, volume long, source string, batch_id string",
    "dim_model_state": f"{_KEYS}, state string, reason string, changed_by string",
    "ldr_prices": "load_id long, load_timestamp timestamp, batch_id string, symbol string, date date, open double, high double, low double, close double, adj_close double, volume long, security_base_id long, process_status string, reject_reason string",
    "ldr_prices_hist": "load_id long, load_timestamp timestamp, batch_id string, symbol string, date date, open double, high double, low double, close double, adj_close double, volume long, security_base_id long, process_status string, reject_reason string, archived_timestamp timestamp",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def bootstrap(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> list[str]:
    """Temp views of all tables (empty where none is given) and of the latest, interval and report views on them."""
    given = tables or {}
    for name in TABLES:
        (given.get(name) or spark.createDataFrame([], schema(name))).createOrReplaceTempView(name)
    made = list(TABLES)
    for name in ("dim_security", "fact_model_definition", "fact_backtest_run", "dim_model_state"):
        view = "vew_" + name.split("_", 1)[1]
        df = spark.table(name)
        temporal.latest(df, key=["base_id"], order=["hist_id"]).createOrReplaceTempView(view)
        made.append(view)
    temporal.intervals(spark.table("dim_security").withColumn("__seq", spark.table("dim_security")["hist_id"]), key=["base_id"], ts="hist_id", tie="__seq").drop("__seq").createOrReplaceTempView("vt2_security")
    spark.sql("SELECT r.base_id, r.model, m.type, r.start_date, r.end_date, r.results.sharpe, r.results.total_return, r.results.max_drawdown, r.results.total_trades FROM vew_backtest_run r LEFT JOIN vew_model_definition m ON m.name = r.model").createOrReplaceTempView("rpt_backtest_summary")
    return [*made, "vt2_security", "rpt_backtest_summary"]


def describe(spark: SparkSession) -> DataFrame:
    """``table, column, type`` of everything registered."""
    rows = [(x.name, c.name, c.dataType) for x in spark.catalog.listTables() for c in spark.catalog.listColumns(x.name)]
    return spark.createDataFrame(rows, "`table` string, `column` string, `type` string")


#: Words that a read-only statement may not have.
DENIED = ("insert", "update", "delete", "drop", "create", "alter", "attach", "detach", "pragma", "vacuum", "replace", "truncate")
MOST_ROWS = 2000


def clamp(n: int, most: int) -> int:
    return min(max(1, n), most)


def read_only(spark: SparkSession, sql: str, limit: int = 100) -> tuple[DataFrame, int]:
    """A query's rows, at most ``limit`` (clamped), or ``ValueError`` if it isn't a plain query."""
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "''", sql.lower())))
    if bad := words & set(DENIED):
        raise ValueError(f"not allowed: {', '.join(sorted(bad))}")
    if not re.match(r"\s*(select|with|values|from)\b", sql, re.I) or ";" in sql.strip().rstrip(";"):
        raise ValueError("one SELECT only")
    n = clamp(limit, MOST_ROWS)
    return spark.sql(sql.strip().rstrip(";")).limit(n), n
