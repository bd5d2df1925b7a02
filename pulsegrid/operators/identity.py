"""Who is behind a wallet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..constants import LOGIN_BADGES, NO_LOGIN_BADGE
from ..functions.numbers import percent
from ..functions.wallets import short_wallet


def _first(account_type: str, field: str) -> str:
    """SQL of the first non-empty `field` among the linked accounts of one type."""
    return f"get(filter(linked_accounts, a -> a.type = '{account_type}' AND a.{field} <> ''), 0).{field}"


_PRESENT = ["google IS NOT NULL OR google_name IS NOT NULL", "mail IS NOT NULL", "apple IS NOT NULL",
            "twitter IS NOT NULL", "phone IS NOT NULL"]


def _by_priority(name: str, *values: str) -> str:
    """SQL of one value per kind of account, for the first kind in label order that is present."""
    cases = " ".join(f"WHEN {cond} THEN {value}" for cond, value in zip(_PRESENT, values))
    return f"CASE {cases} ELSE {values[-1]} END AS {name}"


def extract_identity(users: DataFrame) -> DataFrame:
    """Per user: best label, login type, contact, e-mail and lower-cased wallets.

    Label order: google name, google e-mail, e-mail, apple e-mail, @twitter, phone.
    """
    found = schemas.conform(users, schemas.USERS).selectExpr(
        "id AS user_id", "ingest_order",
        f"{_first('email', 'address')} AS mail",
        f"{_first('google_oauth', 'email')} AS google",
        f"{_first('google_oauth', 'name')} AS google_name",
        f"{_first('apple_oauth', 'email')} AS apple",
        f"{_first('phone', 'number')} AS phone",
        f"{_first('twitter_oauth', 'username')} AS twitter",
        "transform(filter(linked_accounts, a -> a.type = 'wallet' AND a.address <> ''), a -> lower(a.address)) AS linked")
    return found.selectExpr(
        "user_id", "ingest_order",
        _by_priority("label", "coalesce(google_name, google)", "mail", "apple", "concat('@', twitter)", "phone", "NULL"),
        _by_priority("login_type", "'google'", "'email'", "'apple'", "'twitter'", "'phone'", "'wallet_only'"),
        _by_priority("contact", "google", "mail", "apple", "NULL", "phone", "NULL"),
        "coalesce(mail, google, apple) AS email",
        "coalesce(linked, cast(array() AS array<string>)) AS wallets")


OWNED = ["user_id", "label", "login_type", "contact", "email"]


def wallet_rows(users: DataFrame, order_col: str = "ingest_order") -> DataFrame:
    """One row per user and linked wallet."""
    people = extract_identity(users if order_col == "ingest_order"
                              else users.withColumn("ingest_order", F.col(order_col)))
    return people.select(F.explode("wallets").alias("wallet"), "ingest_order", *OWNED)


def owner() -> Column:
    return F.max_by(F.struct(*OWNED), F.struct("ingest_order", "user_id"))


def wallet_identity(users: DataFrame, *, order_col: str = "ingest_order") -> DataFrame:
    """One row per lower-cased wallet; where users share one, the last by `order_col` owns it."""
    return wallet_rows(users, order_col).groupBy("wallet").agg(owner().alias("_owner")).select("wallet", "_owner.*")


def login_badge(login_type: str) -> Column:
    """Display name of a login type column."""
    cases = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in LOGIN_BADGES.items())
    return F.expr(f"CASE {login_type} {cases} ELSE '{NO_LOGIN_BADGE}' END")


def _people(identity: DataFrame) -> DataFrame:
    return identity.select(F.col("wallet").alias("_wallet"), F.col("label").alias("_label"),
                           F.col("contact").alias("_contact"), F.col("login_type").alias("_login"))


def with_labels(joined: DataFrame, wallet_col: str) -> DataFrame:
    return joined.withColumns({
        "user_label": F.coalesce(F.when(F.length("_label") > 0, F.col("_label")),
                                 short_wallet(F.col(wallet_col))),
        "user_contact": F.coalesce("_contact", F.lit("")),
        "login_type": login_badge("_login"),
    }).drop("_wallet", "_label", "_contact", "_login")


def enrich_identity(df: DataFrame, identity: DataFrame, wallet_col: str = "wallet_address", *,
                    hot: bool = True) -> DataFrame:
    """Adds `user_label`, `user_contact` and `login_type` by wallet, case-insensitively.

    No join hint: the identity table grows with the users, so the engine broadcasts it only when
    its measured size allows, and otherwise shuffles both sides by wallet. With `hot` one wallet may
    own much of `df`: the join key is then an expression on both sides, so the join brings its own
    shuffle to both and the engine can split a skewed partition, which it cannot do on top of the
    aggregation that `wallet_identity` ends with. Frames with one row per wallet save that shuffle with `hot=False`.
    """
    key = F.concat(F.col("_wallet"), F.lit("")) if hot else F.col("_wallet")
    joined = df.join(_people(identity), F.lower(F.col(wallet_col)) == key, "left")
    return with_labels(joined, wallet_col)


def enrich_top(df: DataFrame, people: DataFrame, wallet_col: str = "wallet_address") -> DataFrame:
    """enrich_identity for a top-k list, from user profiles or from a stored identity table.

    The list has at most k rows, k being a display size, so it is the side that is broadcast: wallets are
    streamed past it as they come out of the profiles, and only those of the list go on to the
    choice of an owner. The user table is neither shuffled nor sorted. An outer join cannot keep
    the broadcast side's rows, so the list is added once more without identity and the two are folded
    by row. Both uses of the list read the one-partition shuffle of its k rows, so it is computed once.
    """
    rows = df.repartition(1).withColumn("_row", F.row_number().over(Window.orderBy(*df.columns)))
    columns = rows.columns
    wanted = F.broadcast(rows.select("_row", F.lower(F.col(wallet_col)).alias("_wallet")))
    if "linked_accounts" in people.columns:
        found = wallet_rows(people).join(wanted, F.col("wallet") == F.col("_wallet"))
        found = found.groupBy("_row").agg(owner().alias("_owner")).select("_row", "_owner.*")
    else:
        found = people.join(wanted, F.col("wallet") == F.col("_wallet"))
    known = found.select("_row", F.col("label").alias("_label"), F.col("contact").alias("_contact"), F.col("login_type").alias("_login"))
    none = F.lit(None).cast("string")
    blank = {c: none.alias(c) for c in ("_label", "_contact", "_login")}
    listed = rows.select(F.struct(*columns).alias("_list"), "_row", *blank.values())
    empty = F.lit(None).cast(listed.schema["_list"].dataType).alias("_list")
    both = listed.unionByName(known.select(empty, "_row", "_label", "_contact", "_login"))
    folded = both.groupBy("_row").agg(*[F.max(c).alias(c) for c in ("_list", *blank)]).select("_list.*", *blank)
    return with_labels(folded, wallet_col).drop("_row")


def matched_users(ev: DataFrame, identity: DataFrame) -> DataFrame:
    """Users with a known identity, all users, and the share."""
    wallets = ev.where(F.col("wallet_address").isNotNull()).select("wallet_address").distinct()
    known = wallets.join(identity.select("wallet"), F.lower("wallet_address") == F.col("wallet"), "left")
    return (known.agg(F.count("wallet").alias("matched_users"), F.count("*").alias("unique_users"))
            .withColumn("matched_pct", percent(F.col("matched_users"), F.col("unique_users"))))
