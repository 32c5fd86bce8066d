"""The dataset tools: one line each, all read by the point-in-time reader.

A line has the tool's name, the key of a version, the time that windows cut, the order of its rows (`-` before a column for
descending), the columns in percent, and the text columns that a search looks in. `.` stands for none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vantidal.errors import Refusal
from vantidal.sources.datasets import MOST_ROWS, Dataset, Fetched, read_dataset

#: Keys and columns are those of the row models.
LINES = """
credit_trace_aggregates | report,product_category,breakdown,metric,date | date | date,product_category,breakdown,metric | . | .
macro_bea_table | table_name,line_number,date | date | line_number,date | . | .
macro_bls_series | series_id,date | date | series_id,date | . | .
macro_boe_series | series_code,date | date | series_code,date | . | .
macro_boj_series | database,series_code,date | date | series_code,date | . | .
macro_census_trade | flow,hs_code,country_code,month | month | flow,hs_code,country_code,month | . | .
macro_jgb_yields | tenor,date | date | date,tenor | rate | .
macro_regional_fed_surveys | bank,survey,series,seasonally_adjusted,month | month | bank,survey,series,month | . | .
macro_release_schedule | release,reference_month | scheduled_at | scheduled_at,release | . | .
macro_series | series_id,date | date | series_id,date,knowledge_time | . | .
macro_series_catalog | series_id | . | series_id | . | series_id,name
twse_taiex | index,date | date | date | . | .
company_ir_documents | ticker,document_url | published | -published,title | . | title
company_ir_targets | ticker,document_url,metric,horizon | published | -published,metric | . | .
filings_events | accession_number,item | accepted_at | -accepted_at,-accession_number,item | . | headline
sec_13f_holdings | filer_cik,period_end,accession_number,line | period_end | -period_end,accession_number,line | . | .
sec_daily_index | index_date,accession_number | index_date | form,company,accession_number | . | .
sec_earnings_figures | accession_number,exhibit,metric | accepted_at | -accepted_at,metric | . | .
sec_earnings_guidance | accession_number,exhibit,metric,period_label,basis | accepted_at | -accepted_at,metric,period_label | . | .
sec_earnings_non_gaap | accession_number,exhibit,metric,basis | accepted_at | -accepted_at,metric | . | .
sec_earnings_release_figures | accession_number,exhibit,metric,basis,segment,period_end,column | accepted_at | -accepted_at,metric,-period_end | . | .
sec_earnings_releases | accession_number | accepted_at | -accepted_at,-accession_number | . | .
sec_filings | accession_number | filing_date | -accepted_at,-accession_number | . | .
sec_foreign_quarterly | accession_number,statement,line,member,period_end | period_end | -period_end,statement,line | . | .
sec_form144 | accession_number,line | accepted_at | -accepted_at,-accession_number,line | . | .
sec_fund_expenses | class_id,filing_date | filing_date | class_id,-filing_date | management_fee,gross_expense_ratio,net_expense_ratio | .
sec_fund_holdings | series_id,accession_number,line | report_date | line | pct_value | .
sec_fund_nport | series_id,report_date,accession_number | report_date | -report_date,-accession_number | . | .
sec_fundamentals | ticker,metric,basis,period_end | period_end | metric,-period_end | . | .
sec_insider_trades | accession_number,line | transaction_date | -transaction_date,accession_number,line | . | .
sec_ipo_pipeline | cik,accession_number,stage | accepted_at | -accepted_at,company | . | company
sec_pay_vs_performance | ticker,fiscal_year,measure,executive | period_end | -fiscal_year,measure,executive | . | .
sec_release_kpis | accession_number,exhibit,kpi,period_end,column | accepted_at | -accepted_at,kpi,-period_end | . | .
sec_segment_facts | accession_number,concept,member_key,period_end | period_end | -filed,concept,member_key,-period_end | . | .
sec_xbrl_facts | ticker,taxonomy,metric,unit,period_start,period_end,accession_number | period_end | metric,-period_end,accession_number | . | .
sec_xbrl_frames | taxonomy,tag,unit,period,cik | period_end | -value,cik | . | entity_name
twse_monthly_revenue | company_code,month,publication | month | company_code,month | mom_change,yoy_change,ytd_yoy_change | .
bank_fdic_financials | cert,report_date | report_date | name,report_date | net_interest_margin,roa,roe,leverage_ratio | .
bank_fdic_industry | year_end,location,charter_class | year_end | year_end,charter_class | . | .
fed_beige_book | edition,district | release_date | -release_date,district | . | text
fed_fomc_meetings | start_date | start_date | start_date | . | .
fed_fomc_minutes | meeting_date | meeting_date | -meeting_date | . | text
fed_fomc_projections | meeting_date,kind,variable,horizon,midpoint | meeting_date | -meeting_date,variable,horizon,midpoint | . | .
fed_fomc_statements | meeting_date | meeting_date | -meeting_date | . | text
fed_reference_rates | rate_type,date | date | rate_type,date | rate,target_from,target_to | .
fed_z1 | table,series,date | date | table,series,date | . | .
funds_mmf_statistics | table,category,item,month | month | table,item,month | . | .
treasury_auctions | cusip,auction_date | auction_date | -auction_date,cusip | high_yield,high_investment_rate,high_discount_rate,interest_rate | .
treasury_debt | date | date | date | . | .
treasury_tga | account_type,date | date | date,account_type | . | .
treasury_yield_curve | tenor,date | date | date,tenor | rate | .
calendar_us_holidays | publisher,market,holiday_date | holiday_date | holiday_date,market | . | name
calendar_earnings | ticker,report_date | report_date | report_date,ticker | surprise_pct | .
calendar_earnings_history | ticker,fiscal_quarter | report_date | ticker,-report_date | surprise_pct | .
calendar_economic | event_date,event_name,country | release_at | release_at,event_name | . | event_name
"""


@dataclass(frozen=True)
class Tool:
    name: str
    spec: Dataset


def _list(text: str) -> list[str]:
    return [] if text.strip() == "." else [x.strip() for x in text.split(",")]


def parse(line: str) -> Tool:
    name, key, time, order, percents, search = (p.strip() for p in line.split("|"))
    ways = tuple((c.lstrip("-"), "desc" if c.startswith("-") else "asc") for c in _list(order))
    return Tool(name, Dataset(tuple(_list(key)), None if time == "." else time, ways, tuple(_list(percents)), search=tuple(_list(search))))


TOOLS = {t.name: t for t in map(parse, LINES.strip().splitlines())}


def read_tool(
    df: DataFrame, name: str, as_of: str | None = None, vintages: str = "latest", start: str | None = None, end: str | None = None,
    q: str | None = None, most: int = MOST_ROWS, **equal: object,
) -> Fetched:
    """A tool's rows from its table of versions. Every column of the table can be filtered by a value or a list."""
    if name not in TOOLS:
        raise Refusal("invalid_arguments", f"There is no tool {name}.", f"There are {', '.join(TOOLS)}.")
    return read_dataset(df, TOOLS[name].spec, as_of, vintages, start, end, q, most, **equal)


def open_tool(spark: SparkSession, root: str, name: str, **arguments: object) -> Fetched:
    """A tool's rows from its landed table `<root>/<name>.parquet`."""
    return read_tool(spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet"), name, **arguments)
