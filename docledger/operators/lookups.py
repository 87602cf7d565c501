"""Lookups of codes in small tables, and their set-like relatives.

A code table is broadcast only if it is known to be small: ``small`` counts it up to a bound first. Beyond the bound the same join
runs as a shuffled one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.text import norm_name, text
from ..functions.values import code_format, digits_only
from ..sources.shared import staged
from .key_search import bloom, finder

BROADCAST_ROWS = 100_000


def small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``rows`` rows, else with a merge hint."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim.hint("merge")


def with_overrides(defaults: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """Code table whose rows a second table replaces key by key."""
    values = [c for c in defaults.columns if c not in key]
    other = overrides.select(*key, *(F.col(c).alias(f"__o_{c}") for c in values), F.lit(True).alias("__o"))
    return defaults.join(other, key, "full").select(*key, *(F.when(F.col("__o"), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def vendor_code(df: DataFrame, vendors: DataFrame, client: str = "_client_tax_id", tax: str = "E_tax_id_13") -> DataFrame:
    """D_vendor_code by (client, vendor tax id): a well-formed code; known client without one: the label stays, else Unknown."""
    dim = vendors.where(code_format("vendor_code", "vendor")).select(F.col("client_tax_id").alias("__c"), F.col("vendor_tax_id").alias("__v"), F.col("vendor_code").alias("__code"))
    joined = df.join(small(dim), (F.col(client) == F.col("__c")) & (F.col(tax) == F.col("__v")), "left")
    return joined.withColumn("D_vendor_code", F.coalesce("__code", F.nullif(F.trim(text("D_vendor_code")), F.lit("")), F.lit("Unknown"))).drop("__c", "__v", "__code")


FEW_KEYS = 256


#: Grams are as long as the longest of these that a key has room for: the longer a gram, the fewer keys share it.
WIDTHS = (24, 12, 6, 3)


def rarest_grams(keys: DataFrame) -> DataFrame:
    """A postings index of keys (__key, ...): each key under its rarest gram of a width in ``WIDTHS`` (the whole key, if it is shorter), as
    __gram and the gram's place in the key from 0, __off."""
    n = F.length("__key")
    size = F.coalesce(*(F.when(n >= w, F.lit(w)) for w in WIDTHS), n)
    places = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(F.substring(F.col("__key"), i, size).alias("gram"), (i - 1).alias("off")))
    each = keys.withColumn("__place", F.explode(places)).select("*", F.col("__place.gram").alias("__gram"), F.col("__place.off").alias("__off")).drop("__place")
    held = each.groupBy("__gram").agg(F.count_distinct("__key").alias("__n"))
    met = each.hint("merge").join(held.hint("merge"), "__gram")
    columns = [c for c in keys.columns if c != "__key"]
    best = F.min_by(F.struct("__gram", "__off"), F.struct("__n", "__gram", "__off")).alias("__at")
    return met.groupBy("__key", *columns).agg(best).select("__key", *columns, F.col("__at.__gram").alias("__gram"), F.col("__at.__off").alias("__off"))


def key_hits(rows: DataFrame, keys: DataFrame, place: str | None = None) -> DataFrame:
    """(the columns of rows but __hay, and those of keys): the keys (__key, ...) inside each row's text __hay, however often one stands there;
    where ``place`` names a column of both, only keys of the row's own.

    A text is looked through where it is, in Arrow batches, for substrings that a filter over all keys lets through
    (``key_search``); only those leave it, and meet the keys as they are written. A small table of keys goes along for that; a large
    one meets them in a shuffle."""
    index = staged(rarest_grams(keys))
    own = [c for c in rows.columns if c != "__hay"]
    named = [c for c in keys.columns if c != place]
    before = F.expr("octet_length(left(__key, __off))")
    forms = index.groupBy(F.octet_length("__gram").alias("gram"), before.alias("off"), F.octet_length("__key").alias("key")).agg(F.count("*").alias("n"), F.collect_set(place or F.lit("")).alias("places")).collect()  # one for each length
    if not forms:
        return rows.select(*own).where("false").crossJoin(keys.select(*named).where("false"))
    n_keys, places = sum(r["n"] for r in forms), sorted({p for r in forms for p in r["places"]})
    held, bits = bloom(index, n_keys, place, places)
    find = finder(own, place, places, [(r["gram"], r["off"], r["key"]) for r in forms], rows.sparkSession.sparkContext.broadcast(held), bits)
    found = rows.select(*own, "__hay").mapInArrow(find, StructType([*(rows.schema[c] for c in own), StructField("__found", BinaryType())]))
    other = index.drop("__gram", "__off").withColumn("__known", F.col("__key").cast("binary"))
    other = other.withColumnRenamed(place, "__place") if place else other
    same = (F.col("__found") == F.col("__known")) & (F.col(place) == F.col("__place") if place else F.lit(True))
    met = found.join(F.broadcast(other), same) if n_keys <= BROADCAST_ROWS else found.hint("merge").join(other.hint("merge"), same)
    return met.select(*own, *named)


def contains_longest_first(df: DataFrame, haystack: Column, dim: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The value whose key is inside the text, longest key first, then table order (column ord).

    Up to 256 keys go along as one array. More are indexed by their rarest grams. The rows get numbers and are written once; what
    leaves a text is a number and a key for each meeting. A text is neither a join key nor copied."""
    keys = dim.where(F.length(key) > 0).select(F.lower(key).alias("__key"), F.col(value).alias("__value"), "ord")
    few = keys.orderBy(F.length("__key").desc(), "ord").limit(FEW_KEYS + 1).collect()
    if not few:
        return df.withColumn(out, F.lit(None).cast("string"))
    if len(few) <= FEW_KEYS:
        listed = F.array(*(F.struct(F.lit(r[0]).alias("k"), F.lit(r[1]).alias("v")) for r in few))
        named = df.withColumn("__hay", norm_name(haystack))
        return named.withColumn(out, F.get(F.filter(listed, lambda r: F.instr(F.col("__hay"), r["k"]) > 0), 0)["v"]).drop("__hay")
    numbered = staged(df.drop(out).withColumns({"__hay": norm_name(haystack), "__row": F.monotonically_increasing_id()}))
    best = key_hits(numbered.select("__row", "__hay"), keys).groupBy("__row").agg(F.min_by("__value", F.struct(-F.length("__key"), "ord")).alias(out))
    return numbered.hint("merge").join(best.hint("merge"), "__row", "left").drop("__hay", "__row")


def vendor_tax_from_name(df: DataFrame, names: DataFrame, vendor: str = "D_vendor_code", tax: str = "E_tax_id_13") -> DataFrame:
    """E_tax_id_13, where blank, by a known name (column name, longest first) inside the vendor's."""
    found = contains_longest_first(df, F.col(vendor), names, "name", "vendor_tax_id", "__tax")
    return found.withColumn(tax, F.coalesce(F.nullif(F.trim(text(tax)), F.lit("")), "__tax", F.lit(""))).drop("__tax")


def wallet_code(df: DataFrame, wallets: DataFrame, shops: DataFrame, client: str = "_client_tax_id", seller: str = "_seller_id", shop: str = "_username", body: str | None = None) -> DataFrame:
    """Q_payment_method: by (client, seller id), the id looked for in the text where none is given; else by a shop word in the shop's
    name, then in the text; else it stays."""
    from ..functions.fields import loose_seller_id

    number = F.nullif(digits_only(seller), F.lit(""))
    number = F.coalesce(number, loose_seller_id(body, F.lit(""))) if body else number
    dim = wallets.where(code_format("wallet_code", "wallet")).select(F.col("client_tax_id").alias("__c"), F.col("seller_id").alias("__s"), F.col("wallet_code").alias("__w"))
    # the text is searched first: a large table is met in a shuffle, which a text need not go through
    found = contains_longest_first(df.withColumn("__number", number), F.col(shop), shops, "keyword", "wallet_code", "__named")
    found = contains_longest_first(found, F.col(body), shops, "keyword", "wallet_code", "__inside") if body else found.withColumn("__inside", F.lit(None).cast("string"))
    joined = found.join(small(dim), (F.col(client) == F.col("__c")) & (F.col("__number") == F.col("__s")), "left")
    return joined.withColumn("Q_payment_method", F.coalesce("__w", "__named", "__inside", text("Q_payment_method"))).drop("__c", "__s", "__w", "__named", "__inside", "__number")


def last4(c: Column | str) -> Column:
    x = text(c)
    return F.coalesce(F.nullif(F.regexp_extract(x, "(?:[*xX•]{2,}|(?i:ending(?:\\s+in)?|card))[\\s-]*(\\d{4})\\b", 1), F.lit("")), F.when(F.length(digits_only(x)) >= 4, F.right(digits_only(x), F.lit(4))), F.lit(""))


def card_id(df: DataFrame, cards: DataFrame, source: Column, client: str = "_client_tax_id") -> DataFrame:
    dim = cards.where(code_format("card_id", "card")).select(F.col("client_tax_id").alias("__c"), F.col("last4").alias("__l"), F.col("card_id").alias("__id"))
    return df.join(small(dim), (F.col(client) == F.col("__c")) & (last4(source) == F.col("__l")), "left").withColumn("_card_id", F.coalesce("__id", F.lit(""))).drop("__c", "__l", "__id")


def gl_account(df: DataFrame, accounts: DataFrame, rule: Column, client: str = "_client_tax_id", only_blank: bool = True) -> DataFrame:
    """K_account by (rule, client); 'na' is no account; only_blank: an account that is there stays."""
    dim = accounts.where("account <> 'na'").select(F.col("rule_key").alias("__r"), F.col("client_tax_id").alias("__c"), F.col("account").alias("__a"))
    joined = df.withColumn("__rule", rule).join(small(dim), (F.col("__rule") == F.col("__r")) & (F.col(client) == F.col("__c")), "left")
    own = F.nullif(F.trim(text("K_account")), F.lit(""))
    return joined.withColumn("K_account", F.coalesce(own, "__a", F.lit("")) if only_blank else F.coalesce("__a", own, F.lit(""))).drop("__rule", "__r", "__c", "__a")


def company_name(df: DataFrame, clients: DataFrame, client: str = "_client_tax_id") -> DataFrame:
    dim = clients.select(F.col("client_tax_id").alias("__c"), F.col("tag").alias("__t"))
    return df.join(small(dim), F.col(client) == F.col("__c"), "left").withColumn("A_company_name", F.coalesce("__t", text("A_company_name"))).drop("__c", "__t")


def detect_client(body: Column | str, filename: Column | str, ids: list[str], tags: dict[str, str], configured: list[str]) -> Column:
    """Our own tax id in the text, else the single configured one, else a tag in the file name, else the first configured."""
    from ..functions.candidates import let
    from ..functions.classify import has_word
    from ..functions.text import normalize_token, stem

    inside = F.coalesce(*(F.when(F.contains(text(body), F.lit(i)), i) for i in ids), F.lit(None)) if ids else F.lit(None)
    named = lambda tokens: F.coalesce(*(F.when(has_word(tokens, tag), tax) for tag, tax in tags.items()), F.lit(None))
    tagged = [let(normalize_token(stem(filename)), named)] if tags else []
    single = [F.lit(configured[0])] if len(configured) == 1 else []
    return F.coalesce(inside, *single, *tagged, *([F.lit(configured[0])] if configured else []), F.lit(""))


def apply_edits(rows: DataFrame, edits: DataFrame, key: str = "doc_id", locked: tuple[str, ...] = ("A_seq",)) -> DataFrame:
    """Saved cell edits over rows: of each (row, column) the latest; locked columns stay."""
    latest = edits.where(~F.col("column").isin(*locked)).groupBy(key, "column").agg(F.max_by("value", F.struct("saved_at", "value")).alias("value"))
    maps = latest.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__edits"))
    joined = rows.join(maps, key, "left")
    cells = [c for c in rows.columns if c != key and c not in locked and not c.startswith("_")]
    return joined.withColumns({c: F.coalesce(F.try_element_at("__edits", F.lit(c)), F.col(c)) for c in cells}).drop("__edits")


def exclude_own(df: DataFrame, own: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(small(own.select(F.col(key).alias(column)).distinct()), column, "left_anti")


def only_listed(df: DataFrame, allowed: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(small(allowed.select(F.col(key).alias(column)).distinct()), column, "left_semi")
