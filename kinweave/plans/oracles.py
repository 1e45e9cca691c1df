"""DuckDB SQL of the stages, written apart from the DataFrame code and put together by name."""

from __future__ import annotations

from . import fixtures as fx

# Fixed values, written here once more so that an error in the library's own does not pass.
TOLL_FREE = ["800", "888", "877", "866", "855", "844"]
NO_NAME = ["valued customer", "customer", "valued", "anycart", "albertsons", "safeway"]
NO_FIRST_OR_LAST = ["test", "notgiven", "noname", "valued customer", "customer", "valued", "anycart", "albertsons", "safeway", "na", "n/a", "", " "]
NO_EMAIL_USER = ["n/a", " ", "", "na", "n a", "no", "none", "noemail", "email", "albertsons", "safeway", "invalid"]
NO_ADDRESS = ["n/a", " ", "", "na", "n a", "no", "none", "albertsons", "safeway", "invalid"]
EMAIL = r'''^(?:[\-!#-'*+/-9=?A-Z\^-~]+(?:\.[\-!#-'*+/-9=?A-Z\^-~]+)*|"(?:[\]!#-\[\^-~ \t]|(?:\\[\t -~]))+")@(?:[\-!#-'*+/-9=?A-Z\^-~]+(?:\.[\-!#-'*+/-9=?A-Z\^-~]+)*|\[[\t -Z\^-~]*\])\z'''


def listed(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def scrub(e: str, *words: str) -> str:
    for w in words:
        e = f"replace({e}, '{w}', '')"
    return e


def alpha(e: str) -> str:
    return f"regexp_replace({e}, '[^A-Za-z]+', '', 'g')"


def alnum(e: str) -> str:
    return f"regexp_replace({e}, '[^A-Za-z0-9]+', '', 'g')"


def words(e: str) -> str:
    return rf"list_filter(string_split_regex(trim({e}), '\s+'), lambda t: t <> '')"


def soundex(e: str) -> str:
    """American Soundex: H and W are passed over, runs of a code count once, other signs part runs; what begins with no letter stays as it is."""
    codes = f"translate(regexp_replace(upper({e}), '[^A-Z]', 'A', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    codes = f"substr({codes}, 1, 1) || replace(substr({codes}, 2), '7', '')"
    for digit in "123456":
        codes = f"regexp_replace({codes}, '{digit}{{2,}}', '{digit}', 'g')"
    return f"case when regexp_matches({e}, '^[A-Za-z]') then upper(substr({e}, 1, 1)) || rpad(substr(replace(substr({codes}, 2), '0', ''), 1, 3), 3, '0') else {e} end"


def pick(e: str, want: int) -> str:
    w = words(e)
    this, other = f"coalesce(({w})[{want + 1}], '')", f"coalesce(({w})[{2 - want}], '')"
    return f"case when {e} in {listed(NO_FIRST_OR_LAST)} then '' when len({w}) = 1 then ({w})[1] when length({this}) > length({other}) or length({this}) >= 3 then {this} else {other} end"


def name(e: str) -> str:
    low = f"lower(coalesce({e}, ''))"
    kept = f"case when {low} in {listed(NO_NAME)} then '' else {low} end"
    return "lower(" + scrub(rf"trim(regexp_replace({kept}, '[^A-Za-z\s]+', '', 'g'))", "n/a", "n a", "na") + ")"


def other(e: str) -> str:
    return "coalesce(trim(" + scrub(f"lower({e})", "none", "nan") + "), '')"


def address(e: str) -> str:
    e = rf"regexp_replace(lower({e}), '[^a-z0-9\s]', ' ', 'g')"
    e = rf"regexp_replace(regexp_replace({e}, '([0-9])([a-z])', '\1 \2', 'g'), '([a-z])([0-9])', '\1 \2', 'g')"
    return "trim(" + scrub(rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))", "n/a", "na", "n a") + ")"


DIGITS = "regexp_replace(phone, '[^0-9]+', '', 'g')"
PHONE_OK = f"coalesce(length(phone) >= 10 and regexp_full_match({DIGITS}, '[2-9][0-9]{{2}}[2-9][0-9]{{6}}') and substr({DIGITS}, 1, 3) not in {listed(TOLL_FREE)}, false)"
FULL = " ".join(f"when '{v}' then '{r[0]}'" for r in fx.SUFFIXES for v in r[1:])
EMAIL_SQL = EMAIL.replace("'", "''")

#: Common table expressions by name, in an order in which each needs only earlier ones.
CTES = {
    "phoned": f"select * replace (case when {PHONE_OK} then phone else '' end as phone), {PHONE_OK} as is_valid_phone_number from accounts",
    "named": f"""select lower(coalesce(card_nbr, '')) as card_nbr, {other('household_id')} as household_id, {other('phone')} as phone, {name('first_nm')} as first_nm_orig,
  {name('last_nm')} as last_nm_orig, {other('address_line1')} as address_line1, {other('address_line2')} as address_line2, {other('email_address')} as email_address,
  {other('first_txn_dte')} as first_txn_dte, lower(coalesce(first_used_store_id, '9999')) as first_used_store_id, coalesce(first_used_zip_code, '99999') as first_used_zip_code,
  {other('first_upc')} as first_upc, dw_last_update_ts from phoned""",
    "picked": f"select *, {pick('first_nm_orig', 0)} as first_nm, {pick('last_nm_orig', 1)} as last_nm from named",
    "mailed0": f"select * replace ({scrub('split_part(low, chr(64), 1)', 'n/a', 'na')} as user0) from (select *, lower(coalesce(email_address, '')) as low, '' as user0 from picked)",
    "mailed": f"""select * exclude (low, user0, email_address), low as email_address_old, case when user0 in {listed(NO_EMAIL_USER)} then '' else user0 end as email_user,
  case when user0 in {listed(NO_EMAIL_USER)} then '' when low in ('na', 'n/a') or split_part(low, '@', 1) in {listed(w for (w,) in fx.PROFANE)} or not regexp_matches(low, '{EMAIL_SQL}') then ''
  else {scrub('low', 'n/a', 'na')} end as email_address from mailed0""",
    "placed0": "select *, concat_ws(' ', nullif(address_line1, ''), nullif(address_line2, '')) as address_old from mailed",
    "placed1": f"select *, {address('address_old')} as a0 from placed0",
    "placed2": rf"select *, string_split({address('a1')}, ' ') as parts from (select *, case when a0 in {listed(NO_ADDRESS)} or regexp_full_match(a0, '[0-9\s]*') then '' else a0 end as a1 from placed1)",
    "placed3": f"select *, array_to_string(list_transform(range(len(parts)), lambda i: case when i >= 2 then case parts[i + 1] {FULL} else parts[i + 1] end else parts[i + 1] end), ' ') as a2 from placed2",
    "cleaned": f"""select * exclude (a0, a1, a2, parts), cast(length(a2) as integer) as len_add, cast(len({words('a2')}) as integer) as len_add_comp,
  case when contains(a2, 'general delivery') or starts_with(a2, 'po box') then '' else a2 end as address from placed3""",
    "labelled": f"select lower(name) as name, lower(substr(gender, 1, 1)) as label from {fx.values_sql(fx.LABELLED, ['name', 'gender'])}",
    "letters": "select name, label, unnest([{'f': 'first1', 'v': substr(name, 1, 1)}, {'f': 'first2', 'v': substr(name, 1, 2)}, {'f': 'last1', 'v': right(name, 1)}, {'f': 'last2', 'v': right(name, 2)}, {'f': 'last3', 'v': right(name, 3)}]) as x from labelled",
    "nb": """select k.f as feature, k.v as value, t.label, ln((coalesce(c.n, 0) + 0.5::double) / (t.total + 0.5 * b.bins)) as logp
  from (select distinct x.f as f, x.v as v from letters) k cross join (select label, count(*) as total from labelled group by label) t
  join (select x.f as f, count(distinct x.v) as bins from letters group by x.f) b on b.f = k.f
  left join (select x.f as f, x.v as v, label, count(*) as n from letters group by all) c on c.f = k.f and c.v = k.v and c.label = t.label
  union all select '', '', label, ln(count(*) + 0.5::double) from labelled group by label""",
    "asked": "select distinct first_nm as name from cleaned where first_nm <> ''",
    "dims": f"""select a.name, coalesce(u.gender, w.gender) as gender from asked a
  left join (select lower(name) as name, min(lower(substr(gender, 1, 1))) as gender from {fx.values_sql(fx.NAMES_US_CA, ['name', 'gender'])} group by 1) u on u.name = a.name
  left join (select lower(name) as name, min(lower(substr(gender, 1, 1))) as gender from {fx.values_sql(fx.NAMES_ROW, ['name', 'gender'])} group by 1) w on w.name = a.name""",
    "said": """select name, arg_max(label, (score, label)) as gender from (
  select d.name, nb.label, round(sum(nb.logp), 9) as score from dims d join nb on (nb.feature, nb.value) in (('', ''), ('first1', substr(d.name, 1, 1)), ('first2', substr(d.name, 1, 2)), ('last1', right(d.name, 1)), ('last2', right(d.name, 2)), ('last3', right(d.name, 3)))
  where d.gender is null group by d.name, nb.label) group by name""",
    "known": "select c.*, coalesce(d.gender, s.gender, '') as gender from cleaned c left join dims d on d.name = c.first_nm left join said s on s.name = c.first_nm",
    "device_base": "select distinct d.card_nbr, d.mobile_device_id, c.first_nm, c.last_nm, c.email_address from devices d join cleaned c on c.card_nbr = d.card_nbr where d.mobile_device_id in (select mobile_device_id from devices group by 1 having count(distinct card_nbr) > 1)",
    "device_pairs": """select a.card_nbr || b.card_nbr as c1c2, a.mobile_device_id, a.card_nbr as card_nbr_1, b.card_nbr as card_nbr_2, a.first_nm as first_nm_1, b.first_nm as first_nm_2,
  a.last_nm as last_nm_1, b.last_nm as last_nm_2, a.email_address as email_address_1, b.email_address as email_address_2
  from device_base a join device_base b on a.mobile_device_id = b.mobile_device_id and a.card_nbr < b.card_nbr""",
    "device_features": "select *, "
    + ", ".join(f"cast({r}_1 = '' or {r}_2 = '' as integer) as either_null_{r}, cast({r}_1 = '' and {r}_2 = '' as integer) as both_null_{r}, cast({r}_1 <> '' and {r}_1 = {r}_2 as integer) as {n}" for r, n in (("first_nm", "approx_fn"), ("last_nm", "approx_ln"), ("email_address", "same_email_address")))
    + " from device_pairs",
    "device_matches": "select *, cast((approx_fn = 1 and approx_ln = 1) or same_email_address = 1 as integer) as prediction from device_features",
}


def person_pairs(key: str, of: str = "known", cap: str = "< 10000") -> str:
    roles = ("card_nbr", "household_id", "phone", "first_nm", "last_nm", "email_address", "email_user", "address", "gender", "first_txn_dte", "first_used_store_id", "first_upc")
    roles = roles if of == "known" else tuple(r for r in roles if r != "gender")
    both = ", ".join(f"a.{r} as {r}_1, b.{r} as {r}_2" for r in roles)
    blocks = f"(select {key} from {of} where {key} <> '' group by 1 having count(distinct card_nbr) > 1 and count(distinct card_nbr) {cap})"
    return f"select a.card_nbr || b.card_nbr as c1c2, {both} from {of} a join {of} b on a.{key} = b.{key} and a.card_nbr < b.card_nbr where a.{key} in {blocks} and ((a.first_nm <> '' and a.last_nm <> '') or a.email_address <> '')"


def components(edges: str) -> str:
    """Smallest reachable id of every node, from rows src and dst of a table; a walk only goes on where the start may still be the smallest."""
    return f"""(with recursive both_ways as (select src, dst from {edges} union select dst, src from {edges}),
    walk(id, start) as (select distinct src, src from both_ways union select b.dst, w.start from walk w join both_ways b on b.src = w.id where b.dst > w.start)
    select id, min(start) as component from walk group by id)"""


MULTI = """case when trim(substr(phone, 1, 6)) <> '' and trim(address) <> '' and trim(first_nm) <> '' and trim(last_nm) <> '' and trim(first_used_store_id) <> '' and len_add >= 3 and len_add_comp >= 3
  and length(first_nm) >= 2 and length(last_nm) >= 2 then concat_ws('-', substr(phone, 1, 6), address, first_nm, last_nm, first_used_store_id) end"""


def first_card(of: str, column: str, card: str) -> str:
    """First card of each component of rows with component and the levels."""
    return f"select component, arg_min({card}, (first_txn_dte, first_used_store_id, first_upc, {card})) as {column} from {of} group by component"


CTES |= {
    "all_pairs": " union all ".join(person_pairs(k) for k in ("phone", "email_address", "household_id")),
    "person_edges": f"""select card_nbr_1 as src, card_nbr_2 as dst from ({person_pairs('phone', 'cleaned')}) where (last_nm_1 <> '' and last_nm_1 = last_nm_2) or (email_address_1 <> '' and email_address_1 = email_address_2)
  union all select card_nbr_1, card_nbr_2 from device_matches where prediction = 1""",
    "person_components": f"select * from {components('person_edges')}",
    "person_first": first_card("(select c.*, p.component from cleaned c join person_components p on p.id = c.card_nbr)", "shopper_first_card_nbr", "card_nbr"),
    "persons": "select c.*, coalesce(f.shopper_first_card_nbr, c.card_nbr) as shopper_first_card_nbr from cleaned c left join person_components p on p.id = c.card_nbr left join person_first f on f.component = p.component",
    "household_cards": f"select *, shopper_first_card_nbr as shopper_id, {MULTI} as multi_key from persons",
    "household_edges": " union all ".join(
        f"select b.first as src, c.card_nbr as dst from household_cards c join (select {k} as k, min(card_nbr) as first from household_cards where {k} <> '' group by 1 having count(distinct card_nbr) between 2 and 10000) b on b.k = c.{k} where b.first < c.card_nbr"
        for k in ("shopper_id", "phone", "multi_key")
    ),
    "household_components": f"select * from {components('household_edges')}",
    "household_first": first_card("(select c.*, p.component from persons c join household_components p on p.id = c.card_nbr)", "hhid_first_card_nbr", "shopper_first_card_nbr"),
    "households": "select c.*, coalesce(f.hhid_first_card_nbr, c.shopper_first_card_nbr) as hhid_first_card_nbr from persons c left join household_components p on p.id = c.card_nbr left join household_first f on f.component = p.component",
    "whole_edges": " union ".join(
        f"select b.first as src, c.card_nbr as dst from household_cards c join (select {k} as k, min(card_nbr) as first from household_cards where {k} <> '' group by 1 having count(distinct card_nbr) between 2 and 10000) b on b.k = c.{k} where b.first < c.card_nbr"
        for k in ("shopper_id", "phone", "email_address", "household_id", "multi_key")
    ),
    "whole_components": f"select * from {components('whole_edges')}",
    "whole_first": first_card("(select c.*, p.component from persons c join whole_components p on p.id = c.card_nbr)", "hhid_first_card_nbr", "shopper_first_card_nbr"),
    "whole_households": "select c.*, coalesce(f.hhid_first_card_nbr, c.shopper_first_card_nbr) as hhid_first_card_nbr from persons c left join whole_components p on p.id = c.card_nbr left join whole_first f on f.component = p.component",
    "previous": "select * from accounts where cast(card_nbr as bigint) % 10 < 8",
    "fresh_cards": "select * from accounts where card_nbr not in (select card_nbr from previous)",
    "new_cards": "select card_nbr from fresh_cards " + " ".join(f"union select a.card_nbr from accounts a where a.{k} <> '' and a.{k} in (select {k} from fresh_cards where {k} <> '')" for k in ("phone", "household_id", "email_address")),
    "visits": "select card_nbr, store_id, count(*) as n from transactions group by all",
    "footprint": """select t.card_nbr, min(txn_dte) as first_txn_dte, substr(min(txn_dte || store_id || upc_id), 11, 4) as first_used_store_id, substr(min(txn_dte || store_id || upc_id), 15) as first_upc,
  substr(max(txn_dte || store_id), 11) as last_used_store_id, any_value(m.most) as most_used_store_id
  from transactions t join (select card_nbr, arg_min(store_id, (-n, store_id)) as most from visits group by 1) m on m.card_nbr = t.card_nbr group by t.card_nbr""",
    "name_pairs": """select distinct concat_ws(' ', x.first_nm, x.last_nm, x.address_line1) as a, concat_ws(' ', y.first_nm, y.last_nm, y.address_line1) as b
  from accounts x join accounts y on x.household_id = y.household_id and x.card_nbr < y.card_nbr where x.household_id <> ''""",
}


def sql(select: str, rich: bool = False) -> str:
    """A query over the fixtures and the stages that its text names, in their order."""
    import re

    wanted: list[str] = []

    def need(text: str) -> None:
        for n in CTES:
            if n not in wanted and re.search(rf"\b{n}\b", text):
                wanted.append(n)
                need(CTES[n])

    need(select)
    parts = [f"{n} as ({CTES[n]})" for n in CTES if n in wanted]
    return "with " + ",\n".join([fx.RICH_CTES if rich else fx.ACCOUNTS_CTES, *parts]) + "\n" + select
