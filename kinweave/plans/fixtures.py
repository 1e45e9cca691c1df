"""Account data derived from the driver's tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACCOUNTS_CTES = """tx as (
  select o.o_custkey as k, cast(cast(o.o_orderdate as date) as string) as d,
         lpad(cast(l.l_suppkey as string), 4, '0') as s, lpad(cast(l.l_partkey as string), 8, '0') as u
  from orders o join lineitem l on l.l_orderkey = o.o_orderkey),
first_tx as (select k, min(d || '|' || s || '|' || u) as f from tx group by k),
cust as (select c_custkey as k, cast(floor(c_custkey / 3) as bigint) as g, c_nationkey as n from customer),
accounts as (
select lpad(cast(c.k as string), 8, '0') as card_nbr,
  case when c.k % 5 = 0 then '' else concat('H', lpad(cast(cast(floor(c.k / 4) as bigint) as string), 7, '0')) end as household_id,
  case when c.k % 11 = 0 then null when c.k % 13 = 0 then concat('800', lpad(cast(2000000 + c.g as string), 7, '0'))
       when c.k % 17 = 0 then '12345' else concat('206', lpad(cast(2000000 + c.g as string), 7, '0')) end as phone,
  case c.g % 8 when 0 then case when c.k % 3 = 0 then 'Jonathan' else 'JOHN' end when 1 then 'Mary Ann' when 2 then 'Al Roberto'
       when 3 then 'Susan-Marie' when 4 then 'valued customer' when 5 then case when c.k % 3 = 0 then 'Kathryn' else 'Catherine' end
       when 6 then 'O''Neil' else '' end as first_nm,
  case cast(floor(c.g / 8) as bigint) % 6 when 0 then 'Smith' when 1 then 'De la Cruz' when 2 then 'MacDonald' when 3 then 'Lee'
       when 4 then 'St Clair' else null end as last_nm,
  case when c.k % 19 = 0 then 'PO Box 12' when c.k % 23 = 0 then 'General Delivery'
       else concat(cast(100 + c.g as string), case when c.k % 2 = 0 then ' Maple St.' else ' maple street' end) end as address_line1,
  case when c.k % 4 = 0 then 'Apt5B' else '' end as address_line2,
  case when c.k % 7 = 0 then 'noemail' when c.k % 9 = 0 then concat('bad..', cast(c.k as string), '@x') when c.k % 10 = 0 then 'spam@mail.example'
       else concat('User.', cast(c.g as string), '@Mail', cast(c.n as string), '.example') end as email_address,
  substr(t.f, 1, 10) as first_txn_dte, substr(t.f, 12, 4) as first_used_store_id, lpad(cast(c.n as string), 5, '9') as first_used_zip_code,
  substr(t.f, 17, 8) as first_upc, '2024-01-01 00:00:00' as dw_last_update_ts
from cust c left join first_tx t on t.k = c.k),
devices as (
select distinct lpad(cast(user_id as string), 8, '0') as card_nbr,
  concat('dev-', lpad(cast((user_id * 7 + cast(floor(event_id / 5000) as bigint)) % 61 as string), 4, '0')) as mobile_device_id
from events),
transactions as (select lpad(cast(k as string), 8, '0') as card_nbr, d as txn_dte, s as store_id, u as upc_id from tx),
stores as (select lpad(cast(s_suppkey as string), 4, '0') as store_id, lpad(cast(s_nationkey as string), 5, '0') as zip_code from supplier)"""

#: The same cards with contact data in which every rule finds something: e-mail users that hold the first name, cards of one
#: person on one device, e-mail addresses that persons share.
RICH_CTES = ACCOUNTS_CTES.replace("\naccounts as (", "\nplain as (").replace(
    "devices as (\nselect distinct lpad(cast(user_id as string), 8, '0') as card_nbr,\n  concat('dev-', lpad(cast((user_id * 7 + cast(floor(event_id / 5000) as bigint)) % 61 as string), 4, '0')) as mobile_device_id\nfrom events),",
    """numbered as (select *, cast(card_nbr as bigint) as k, cast(floor(cast(card_nbr as bigint) / 3) as bigint) as g from plain),
accounts as (
select card_nbr, household_id, phone, case when k % 3 = 0 and g % 8 = 0 then 'JOHN' else first_nm end as first_nm, last_nm, address_line1, address_line2,
  case when k % 7 = 0 then 'noemail' when k % 10 = 1 then concat('family.', cast(cast(floor(g / 4) as bigint) as string), '@mail.example')
       when first_nm <> '' then concat(lower(substr(first_nm, 1, 4)), '.', cast(g as string), '@mail.example') else email_address end as email_address,
  first_txn_dte, first_used_store_id, first_used_zip_code, first_upc, dw_last_update_ts from numbered),
devices as (
select card_nbr, concat('dev-', lpad(cast(g as string), 6, '0')) as mobile_device_id from numbered where k % 4 <> 0
union all select lpad(cast(k + 5000000 as string), 8, '0'), concat('dev-', lpad(cast(g as string), 6, '0')) from numbered where k % 9 = 0),""",
)

PROFANE = [("spam",)]
SUFFIXES = [("street", "st", "str"), ("avenue", "ave", "av"), ("road", "rd", "rd."), ("boulevard", "blvd", "boul"), ("lane", "ln", "la"), ("apartment", "apt", "apmt")]
NAMES_US_CA = [("john", "M"), ("mary", "F"), ("susanmarie", "F")]
NAMES_ROW = [("roberto", "M"), ("john", "F"), ("oneil", "M")]
LABELLED = [(n, "F") for n in ("anna", "maria", "laura", "julia", "katherine", "carolyn", "helen", "susan", "catherina", "rosemary")] + [
    (n, "M") for n in ("jonas", "peter", "stephan", "nathan", "robert", "marco", "kevin", "joseph", "ethan", "brian")
]

TABLES = {"accounts": "accounts", "devices": "devices", "transactions": "transactions", "stores": "stores"}


class Fixtures:
    """The derived tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, rich: bool = False):
        self.spark, self.sf_dir, self.ctes = spark, sf_dir, RICH_CTES if rich else ACCOUNTS_CTES

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        sources = {t: self.base(t) for t in ("orders", "lineitem", "customer", "events", "supplier")}
        sql = self.ctes
        for t in sources:
            for word in ("from", "join"):
                sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
        return self.spark.sql(f"with {sql} select * from {name}", **sources)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.derived(name)
        small = {"profane": (PROFANE, ["invalid_name"]), "suffixes": (SUFFIXES, ["full_name", "variant_1", "variant_2"]), "names_us_ca": (NAMES_US_CA, ["name", "gender"]), "names_row": (NAMES_ROW, ["name", "gender"]), "labelled_names": (LABELLED, ["name", "gender"])}
        if name in small:
            rows, columns = small[name]
            return self.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
        raise AttributeError(name)


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """The rows as a DuckDB subquery."""
    cells = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(select * from (values {cells}) v({', '.join(columns)}))"
