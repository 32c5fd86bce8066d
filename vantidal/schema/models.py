"""Row models: a fixed schema whose fields carry units and roles, with the model's time, series and value columns.

The market models that operators know are written here. Further models come from JSON Schema files of the
user's (`from_json_schema`), one class a file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantidal.errors import Refusal

#: Why a value may be missing.
ABSENCE = ("not_applicable", "not_reported", "not_available", "not_recovered", "insufficient_data", "no_data", "not_found", "not_fetched", "withheld", "unknown")

TYPES = {
    "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "decimal": T.DecimalType(38, 12),
    "time": T.TimestampType(), "date": T.DateType(), "strs": T.ArrayType(T.StringType()),
}


@dataclass(frozen=True)
class Model:
    name: str
    schema: T.StructType
    time: str | None = None
    group: str | None = None
    values: tuple[str, ...] = ()
    span: str | None = None  #: a column of the period that a row covers: known at its end
    known_at_fetch: bool = False
    available: str | None = None  #: a column of the time at which a row became known
    units: dict[str, str] = field(default_factory=dict)


def model(name: str, fields: str, time: str | None = None, group: str | None = None, values: str = "", units: str = "", **rules) -> Model:
    """A model from `name:type` fields (`?` after the type: may be null); every model ends with `absent`."""
    unit = dict(u.split("=") for u in units.split())
    out = []
    for f in fields.split():
        c, _, kind = f.partition(":")
        meta = {"unit": unit[c]} if c in unit else {}
        if rules.get("available") == c:
            meta["role"] = "available"
        out.append(T.StructField(c, TYPES[kind.rstrip("?")], kind.endswith("?"), meta))
    out.append(T.StructField("absent", T.MapType(T.StringType(), T.StringType()), True))
    return Model(name, T.StructType(out), time, group, tuple(values.split()), units=unit, **rules)


PRICES = "open=price high=price low=price close=price vwap=price volume=shares"
MODELS = {m.name: m for m in (
    model("Bar", "ticker:str asset_class:str timeframe:str t:time open:float high:float low:float close:float volume:float trade_count:int? vwap:float? currency:str",
          "t", "ticker", "close open high low vwap volume", PRICES, span="timeframe"),
    model("OptionBar", "occ_symbol:str underlying:str timeframe:str t:time open:float high:float low:float close:float volume:float trade_count:int? vwap:float? currency:str",
          "t", "occ_symbol", "close open high low vwap volume", PRICES, span="timeframe"),
    model("Quote", "ticker:str asset_class:str t:time bid_price:float? bid_size:float? bid_exchange:str? ask_price:float? ask_size:float? ask_exchange:str? conditions:strs? tape:str? currency:str",
          "t", "ticker", "bid_price ask_price bid_size ask_size", "bid_price=price ask_price=price"),
    model("Trade", "ticker:str asset_class:str t:time price:float size:float exchange:str? trade_id:str? conditions:strs? tape:str? taker_side:str? currency:str",
          "t", "ticker", "price size", "price=price"),
    model("Snapshot", "ticker:str asset_class:str t:time last_price:float? bid_price:float? ask_price:float? day_close:float? prev_close:float? change:float? change_pct:float? currency:str",
          "t", "ticker", "last_price change_pct", "last_price=price change_pct=fraction", known_at_fetch=True),
    model("SeriesPoint", "series_id:str event_time:time knowledge_time:time value:float?", "event_time", "series_id", "value", available="knowledge_time"),
    model("PortfolioPoint", "environment:str timeframe:str t:time equity:decimal? profit_loss:decimal? profit_loss_pct:float? base_value:decimal?",
          "t", None, "equity profit_loss", "equity=USD profit_loss=USD profit_loss_pct=fraction"),
    model("ReturnPoint", "series:str t:time ret:float kind:str period:str?", "t", "series", "ret", "ret=fraction"),
)}


def from_json_schema(text: str) -> Model:
    """A model from a JSON Schema of an object: x-time, x-group, x-values, and x-unit and x-role of properties."""
    j = json.loads(text)
    if j.get("type") != "object" or "properties" not in j:
        raise Refusal("invalid_arguments", "The schema is none of an object.")
    need, fields, units, available = set(j.get("required", ())), [], {}, None
    for name, p in j["properties"].items():
        options = [o for o in p.get("anyOf", [p]) if o.get("type") != "null"]
        kind = _kind(options[0] if options else p)
        meta = {}
        if u := p.get("x-unit"):
            units[name] = meta["unit"] = u
        if p.get("x-role"):
            meta["role"] = p["x-role"]
            available = name if p["x-role"] == "available" else available
        fields.append(T.StructField(name, kind, name not in need or len(options) < len(p.get("anyOf", [p])), meta))
    return Model(j.get("title", ""), T.StructType(fields), j.get("x-time"), j.get("x-group"), tuple(j.get("x-values", ())), units=units, available=available)


def load_models(folder: str) -> dict[str, Model]:
    """The models of a folder of JSON Schema files, by name; a file that is none of an object is refused by name."""
    from pathlib import Path

    out = {}
    for path in sorted(Path(folder).glob("*.json")):
        try:
            m = from_json_schema(path.read_text())
        except (Refusal, json.JSONDecodeError) as e:
            raise Refusal("invalid_arguments", f"{path.name} is no model: {e}") from None
        out[m.name or path.stem] = m
    return out


def _kind(p: dict) -> T.DataType:
    kind, form = p.get("type"), p.get("format")
    if kind == "string":
        return {"date-time": T.TimestampType(), "date": T.DateType(), "decimal": T.DecimalType(38, 12)}.get(form, T.StringType())
    if kind == "array":
        return T.ArrayType(_kind(p.get("items", {})))
    if kind == "object":
        if "properties" in p:
            return T.StructType([T.StructField(n, _kind(q), True) for n, q in p["properties"].items()])
        return T.MapType(T.StringType(), T.StringType())
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def exact_decimal(text: Column) -> Column:
    """Text as decimal(38, 12), null if it isn't finite or has more digits: never rounded."""
    clean = F.trim(text)
    ok = clean.rlike(r"^[+-]?\d{1,26}(\.\d{0,12}0*)?$")
    return F.when(ok, clean.try_cast("decimal(38,12)"))


def conform(df: DataFrame, to: Model, codes: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """The model's columns in order and type, units in their metadata, and `absent`: why each null is null.

    Decimals are taken from text exactly; with `strict` one that can't be represented fails the query.
    """
    cols = []
    for f in to.schema:
        if f.name == "absent":
            continue
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.DecimalType) and f.name in df.columns:
            exact = exact_decimal(c.cast("string"))
            if strict:
                exact = F.when(c.isNotNull() & exact.isNull(), F.raise_error(F.lit(f"unrepresentable_decimal: {f.name}")).cast(f.dataType)).otherwise(exact)
            c = exact
        cols.append(c.cast(f.dataType).alias(f.name, metadata=f.metadata))
    out = df.select(*cols, *([F.col("absent").alias("__given")] if "absent" in df.columns else []))
    names = [f.name for f in to.schema if f.name != "absent" and f.nullable]
    if names:
        entries = F.array(*(F.struct(F.lit(n).alias("key"), F.when(F.col(n).isNull(), F.lit((codes or {}).get(n, "not_reported"))).alias("value")) for n in names))
        absent = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    else:
        absent = F.create_map().cast("map<string,string>")
    if "absent" in df.columns:
        keep = F.map_filter(absent, lambda k, v: F.coalesce(~F.map_contains_key("__given", k), F.lit(True)))
        absent = F.map_concat(F.coalesce("__given", F.create_map().cast("map<string,string>")), keep)
    return out.withColumn("absent", absent).drop("__given")


def unexplained(df: DataFrame, of: Model) -> DataFrame:
    """Rows with a null that `absent` doesn't explain, with the fields' names."""
    names = [f.name for f in of.schema if f.name != "absent"]
    missing = F.array_compact(F.array(*(
        F.when(F.col(n).isNull() & ~F.coalesce(F.map_contains_key("absent", F.lit(n)), F.lit(False)), F.lit(n)) for n in names
    )))
    return df.withColumn("unexplained", missing).filter(F.size("unexplained") > 0)
