"""Calls of EVM contracts: what they do, and the tokens of a packed swap path; swaps as legs; spam scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, bounded
from .rule_catalogue import DEX_SELECTORS, LENDING_SELECTORS, LP_SELECTORS

# A contract known for spam, each other signal, what counts as spam, and below which price (USD) a transfer is dust.
SPAM_CERTAIN, SPAM_SIGNAL, SPAM_FROM, DUST_USD = 0.99, 0.46, 0.90, 0.001


def selector_of(calldata: Column) -> Column:
    """The first four bytes, lower case; null for none."""
    s = F.lower(F.substring(calldata, 1, 10))
    return F.when(F.length(s) == 10, s)


def kind_of(selector: Column) -> Column:
    return F.when(selector.isin(*DEX_SELECTORS), "swap").when(selector.isin(*LENDING_SELECTORS), "lending").when(selector.isin(*LP_SELECTORS), "lp")


def path_tokens(path_hex: Column) -> Column:
    """Addresses of a packed path: 20 bytes each, three bytes of fee between them."""
    h = F.lower(F.regexp_replace(path_hex, "^0x", ""))
    n = F.floor((F.length(h) - 40) / 46).cast("int")
    return F.when(F.length(h) >= 40, F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("0x"), F.substr(h, i * 46 + 1, F.lit(40)))))


def call_path(calldata: Column) -> Column:
    """The tokens of a packed path in call data: its first word after the selector says where the path's length stands, and the path follows it.

    Null where that points beyond the data, or the data is not hex; no tokens where the path is shorter than one address."""
    def let(value: Column, use) -> Column:  # use(value), with value computed once
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def word(params: Column, at: Column) -> Column:  # twice a word of 32 bytes as a number, null where it ends beyond the data or is larger than any data
        text = F.substr(params, (at + 1).cast("int"), F.lit(64))
        return let(text, lambda t: F.when((F.length(t) == 64) & (F.substr(t, F.lit(1), F.lit(56)) == "0" * 56), F.conv(F.substr(t, F.lit(57), F.lit(8)), 16, 10).cast("long") * 2))

    def path(params: Column) -> Column:
        n = F.length(params)
        cut = lambda at, size: F.when(at + 64 + size <= n, F.coalesce(path_tokens(F.substr(params, (at + 65).cast("int"), size.cast("int"))), F.array().cast("array<string>")))
        return let(word(params, F.lit(0)), lambda at: F.when(at + 64 <= n, let(word(params, at), lambda size: cut(at, size))))

    hexed = let(F.regexp_replace(F.lower(calldata), "^0x", ""), lambda d: F.when(d.rlike("^([0-9a-f]{2})*$"), F.substring(d, 9, 1 << 30)))
    return let(hexed, path)


#: Rules of a block and movements of a tile: what one pair of them gives comes in one piece.
BLOCK_RULES, TILE_MOVES = 256, 1024
#: Rows that one task gives, about.
TASK_ROWS = 1 << 25


def spread_rules(moves: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, tx_id and user_id of every movement of any user that an active rule fits.

    rules: rule_id, rule_type (contract_address: the counterparty, whole; token_symbol: how the token begins), value, is_active; case doesn't
    count. A token is cut to each length that some rule has, and all that a movement can match is compared by equality in one pass; the lengths are one row.

    The rows are as many as movements times rules, so they are formed only where they are given: rules of one value lie in blocks, movements that ask for it in tiles, both
    written first, and a tile is dealt out whole. A block's rules come again for one movement of the tile after the other, so that a written table repeats them closely and takes few bytes a row."""
    spark = moves.sparkSession
    scratch, key = Scratch(spark, "rules"), ["__type", "__v"]
    live = rules.filter("is_active and value <> '' and rule_type in ('contract_address', 'token_symbol')")
    live = scratch.save(live.select("rule_id", F.col("rule_type").alias("__type"), F.lower("value").alias("__v")))
    sizes = live.filter("__type = 'token_symbol'").agg(F.collect_set(F.length("__v")).alias("__sizes"))
    low = F.lower("token")
    named = lambda kind, v: F.struct(F.lit(kind).alias("__type"), v.alias("__v"))
    cuts = F.transform(F.filter("__sizes", lambda n: n <= F.length("token")), lambda n: named("token_symbol", F.substr(low, F.lit(1), n)))
    asked = F.concat(F.array(named("contract_address", F.lower("counterparty"))), cuts)
    many = moves.select("id", "user_id", "counterparty", "token").crossJoin(F.broadcast(sizes)).select(F.col("id").alias("tx_id"), "user_id", F.inline(asked))

    def in_parts(df: DataFrame, counts: DataFrame, by: str, each: int, columns: list[str]) -> DataFrame:  # rows of one value as arrays of so many; a group holds about 16 arrays, its last one is shorter
        group = F.pmod(F.xxhash64(by), F.ceil(F.col("__n") / (16 * each)))
        rows = df.join(bounded(counts), key).groupBy(*key, group.alias("__group")).agg(F.collect_list(F.struct(*columns)).alias("__rows"))
        starts = F.sequence(F.lit(1), F.size("__rows"), F.lit(each))
        return rows.select(*key, F.explode(F.transform(starts, lambda i: F.slice("__rows", i, each))).alias("__rows"))

    n_rules = scratch.save(live.groupBy(*key).agg(F.count("*").alias("__n")))
    many = many.join(bounded(n_rules), key, "left_semi")
    n_moves = scratch.save(many.groupBy(*key).agg(F.count("*").alias("__n")))
    blocks = in_parts(live, n_rules, "rule_id", BLOCK_RULES, ["rule_id"])
    blocks = scratch.save(blocks.select(*key, F.transform("__rows", lambda r: r["rule_id"]).alias("__rules")))
    tiles = scratch.save(in_parts(many, n_moves, "tx_id", TILE_MOVES, ["tx_id", "user_id"]))
    total = n_moves.join(bounded(n_rules.withColumnRenamed("__n", "__r"), n_rules), key).agg(F.sum(F.col("__n").cast("double") * F.col("__r"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // TASK_ROWS))
    # coalesce to as many parts moves nothing, but generated code ends there: it holds all that comes of one row, so a row is a pair, then a movement, and not a tile with all its rules
    pairs = tiles.repartition(tasks).join(bounded(blocks), key).select("__rules", "__rows").coalesce(tasks)
    return pairs.select("__rules", F.inline("__rows")).coalesce(tasks).select(F.explode("__rules").alias("rule_id"), "tx_id", "user_id")


def pool_prices(pools: DataFrame, base: str, base_price: Column) -> DataFrame:
    """token and price: of each token the first pool (by pool_id) of it and base alone, with two reserves above zero, times the price of base.

    pools: pool_id, tokens, amounts (text, as they come). Pools of other sizes, with unequal arrays or amounts that are no numbers are left out."""
    two = pools.filter((F.size("tokens") == 2) & (F.size("amounts") == 2) & F.array_contains("tokens", base))
    side = F.array_position("tokens", base).cast("int")
    amount = lambda i: F.element_at("amounts", i).try_cast("double")
    p = two.select("pool_id", F.element_at("tokens", 3 - side).alias("token"), amount(side).alias("__near"), amount(3 - side).alias("__own"))
    p = p.filter((F.col("__near") > 0) & (F.col("__own") > 0) & (F.col("token") != base))
    return p.groupBy("token").agg(F.min_by(F.col("__near") / F.col("__own") * base_price, "pool_id").alias("price"), F.min("pool_id").alias("pool_id"))


def legs(tokens: Column, fee: Column) -> Column:
    """A swap's parent, sell leg (0), one numbered leg for each token between, buy leg after them and, with a fee, its leg last.

    With more than one hop the parent and the legs between ask for review."""
    n, no, none = F.size(tokens), F.lit(False), F.lit(None).cast("string")
    leg = lambda kind, token, i, review: F.struct(kind.alias("leg_type"), token.alias("token"), i.cast("int").alias("leg_index"), review.alias("needs_review"))
    between = F.transform(F.slice(tokens, 2, F.greatest(n - 2, F.lit(0))), lambda t, i: leg(F.concat(F.lit("intermediate_leg_"), (i + 1).cast("string")), t, i + 1, F.lit(True)))
    out = F.concat(F.array(leg(F.lit("parent"), none, F.lit(0), n > 2), leg(F.lit("sell_leg"), F.get(tokens, F.lit(0)), F.lit(0), no)), between, F.array(leg(F.lit("buy_leg"), F.get(tokens, n - 1), n - 1, no)))
    return F.when(F.coalesce(fee, F.lit(0)) > 0, F.concat(out, F.array(leg(F.lit("fee_leg"), none, n, no)))).otherwise(out)


def spam_score(known_contract: Column, usd: Column, direction: Column, tagged: Column) -> Column:
    """0.99 for a contract known for spam; else a signal each for dust, for dust that came in, and for a tagged token, 1.0 at most. Without a price (or at 0) nothing is dust."""
    dust = (usd > 0) & (usd < DUST_USD)
    signals = (dust, dust & (direction == "in"), tagged)
    total = sum((F.when(F.coalesce(s, F.lit(False)), SPAM_SIGNAL).otherwise(0.0) for s in signals), F.lit(0.0))
    return F.when(F.coalesce(known_contract, F.lit(False)), SPAM_CERTAIN).otherwise(F.least(F.lit(1.0), total))
