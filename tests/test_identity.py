import pytest

from pulsegrid.operators import identity as I

NONE = (None,) * 5
USERS = "id string, ingest_order bigint, linked_accounts array<struct<type:string,address:string,email:string,name:string,number:string,username:string>>"


def account(kind, address=None, email=None, name=None, number=None, username=None):
    return (kind, address, email, name, number, username)


def users(frame, *lists):
    return frame(USERS, [(f"u{i}", i, list(accounts) if accounts is not None else None) for i, accounts in enumerate(lists)])


def one(frame, rows, *accounts):
    return rows(I.extract_identity(users(frame, accounts)))[0]


def test_label_priority(frame, rows):
    everything = [account("phone", number="+1"), account("twitter_oauth", username="tw"), account("apple_oauth", email="a@a"),
                  account("email", address="e@e"), account("google_oauth", email="g@g", name="G")]
    got = [one(frame, rows, *everything[:n]) for n in range(6)]
    assert [g["label"] for g in got] == [None, "+1", "@tw", "a@a", "e@e", "G"]
    assert [g["login_type"] for g in got] == ["wallet_only", "phone", "twitter", "apple", "email", "google"]
    assert [g["contact"] for g in got] == [None, "+1", None, "a@a", "e@e", "g@g"]
    assert [g["email"] for g in got] == [None, None, None, "a@a", "e@e", "e@e"]


def test_first_non_empty_values_are_picked_independently(frame, rows):
    got = one(frame, rows, account("google_oauth", email="", name="First"), account("google_oauth", email="g2@g", name="Second"),
              account("wallet", address="0xAA"), account("wallet", address=""), account("wallet"), account("wallet", address="0xBb"))
    assert (got["label"], got["contact"], got["wallets"]) == ("First", "g2@g", ["0xaa", "0xbb"])
    only_mail = one(frame, rows, account("google_oauth", email="g@g"))
    assert (only_mail["label"], only_mail["login_type"]) == ("g@g", "google")


def test_missing_accounts(frame, rows):
    got = rows(I.extract_identity(users(frame, None, [])))
    assert [(g["label"], g["wallets"]) for g in got] == [(None, []), (None, [])]


def test_last_user_owns_a_shared_wallet(frame, rows):
    df = users(frame, [account("wallet", address="0xAA"), account("email", address="old@e")],
               [account("wallet", address="0xaa"), account("email", address="new@e")])
    for order in (df, df.orderBy("id", ascending=False)):
        got = rows(I.wallet_identity(order))
        assert len(got) == 1 and got[0]["label"] == "new@e" and got[0]["user_id"] == "u1"


def test_enrichment_fallbacks(frame, rows):
    identity = I.wallet_identity(users(frame, [account("wallet", address="0xAAAAAAAA"), account("email", address="e@e")],
                                       [account("wallet", address="0xBBBBBBBB")]))
    df = frame("wallet_address string, n int", [("0xaaaaAAAA", 1), ("0xBBBBBBBB", 2), ("0xCCCCCCCC", 3), (None, 4), ("short", 5), ("short", 5)])
    want = {1: ("e@e", "e@e", "Email"), 2: ("0xBB...BBBB", "", "Wallet"), 3: ("0xCC...CCCC", "", "—"), 4: ("?", "", "—"), 5: ("short", "", "—")}
    people = users(frame, [account("wallet", address="0xAAAAAAAA"), account("email", address="e@e")], [account("wallet", address="0xBBBBBBBB")])
    for enrich, known in ((I.enrich_identity, identity), (I.enrich_top, identity), (I.enrich_top, people)):
        got = rows(enrich(df, known))
        assert len(got) == 6
        for r in got:
            assert (r["user_label"], r["user_contact"], r["login_type"]) == want[r["n"]]


def test_matched_users(frame, rows):
    identity = frame("wallet string", [("0xa",), ("0xb",)])
    ev = frame("wallet_address string", [("0xA",), ("0xA",), ("0xC",), (None,)])
    assert rows(I.matched_users(ev, identity)) == [{"matched_users": 1, "unique_users": 2, "matched_pct": 50.0}]
    assert rows(I.matched_users(ev.where("false"), identity))[0]["matched_pct"] == 0.0


@pytest.fixture()
def no_broadcast(spark):
    """No broadcast by size, and thresholds at which small skew counts."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def many_users(spark, n):
    return spark.range(n).selectExpr("concat('u', id) AS id", "id AS ingest_order", "array(named_struct('type', 'wallet', 'address', concat('0x', id), "
        "'email', cast(null AS string), 'name', cast(null AS string), 'number', cast(null AS string), 'username', cast(null AS string))) AS linked_accounts")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_hot_wallet_is_split(spark, no_broadcast):
    half = spark.range(0, 200_000, 1, 8).selectExpr("CASE WHEN id % 2 = 0 THEN '0x7' ELSE concat('0x', id % 2000) END AS wallet_address", "id AS n")
    joined = I.enrich_identity(half, I.wallet_identity(many_users(spark, 2000)))
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 200_000


def test_lists_do_not_move_the_user_table(spark, no_broadcast):
    few = spark.createDataFrame([(f"0x{i}", i) for i in range(5)], "wallet_address string, n int")
    listed = I.enrich_top(few, many_users(spark, 5000))
    plan = final_plan(listed)
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    stages = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not [line for line in stages if "wallet#" in line]      # users are dealt by no wallet; only the list's row numbers are
    assert sorted(r["n"] for r in listed.collect()) == [0, 1, 2, 3, 4]
