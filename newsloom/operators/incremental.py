"""What is new on a listing, and how it enters the store.

A listing row has its source, an article key and its place in the listing
(newest first). Each source is a cursor of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Into how many parts a cursor's rows are spread for the join with its stop place.
SPREAD = 32


def _place(df: DataFrame, order: list[str]) -> Column:
    """Place of a row as one sortable value.

    A page and a position on it, both whole numbers, are packed into one number,
    which Spark can aggregate by hash. A page of more than 31 bits or a position of
    more than 32 stops the job.
    """
    if len(order) == 1:
        return F.col(order[0])
    whole = {"tinyint", "smallint", "int", "bigint"}
    types = dict(df.dtypes)
    if len(order) == 2 and all(types[c] in whole for c in order):
        page, pos = (F.col(c).cast("bigint") for c in order)
        fits = page.between(0, 2**31 - 1) & pos.between(0, 2**32 - 1)
        wide = F.raise_error(F.lit("a place of a listing is out of range"))
        packed = F.shiftleft(page, 32) + pos
        return F.when(page.isNull() | pos.isNull(), None).when(fits, packed).otherwise(
            wide.cast("bigint")
        )
    return F.struct(*order)


def matched(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``other`` on keys, of which null ones are equal too.

    A cursor without a topic is a cursor like others, so a null key must match. The keys
    are those of ``rows``; for a left join ``other`` adds its further columns.
    """
    named = other.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[c for c in other.columns if c not in keys and how not in ("left_semi", "left_anti")],
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, same, how).drop(*[f"_k_{k}" for k in keys])


def known_keys(listing: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the listing that the store holds.

    The listing's keys are the side Spark broadcasts if they are few, so a big
    store is read once, keys only, and not shuffled.
    """
    wanted = listing.select(*keys).distinct()
    return matched(store.select(*keys), wanted, keys, "left_semi").distinct()


def new_only(listing: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Listing rows whose key is not in the store.

    The listing is read twice so that the store is not shuffled for a small one.
    """
    return matched(listing, known_keys(listing, store, keys), keys, "left_anti")


def exclude_all(
    links: DataFrame,
    stores: list[DataFrame],
    dead: DataFrame | None = None,
    keys: list[str] | str = "article_id",
    entry: str = "entry",
    normalize_keys: bool = False,
) -> DataFrame:
    """Links found in none of the stores and not dead-lettered.

    ``keys`` may name a category before the id, so that stores of several categories
    are told apart. Dead letters hold ids and whole URLs and match the last key. Only
    the ids match a key, so a URL is tried again, unless ``normalize_keys`` cuts it to
    its id first.

    The keys of all stores and the dead letters are one union, tested once against the
    links' keys: the links are read twice, however many stores there are, and the stores
    are not shuffled for a small list of links.
    """
    keys = [keys] if isinstance(keys, str) else keys
    held = [store.select(*keys, F.lit(False).alias("_dead")) for store in stores]
    if dead is not None:
        gone = F.col(entry)
        if normalize_keys:
            gone = F.substring_index(gone, "/", -1)
        # A dead letter has no category: it stands for the id in all of them.
        ids = dead.select(gone.alias(keys[-1]), F.lit(True).alias("_dead")).filter(F.col(keys[-1]).isNotNull())
        held.append(ids)
    if not held:
        return links
    if len(held) == 1 and stores:
        return new_only(links, stores[0], keys)
    known = held[0]
    for more in held[1:]:
        known = known.unionByName(more, allowMissingColumns=True)
    # An inner join: a semi-join would be pushed into the union, once per store.
    wanted = links.select(*[F.col(k).alias(f"_w_{k}") for k in keys]).distinct()
    same = F.col(keys[-1]).eqNullSafe(F.col(f"_w_{keys[-1]}"))
    for k in keys[:-1]:
        same = same & (F.col("_dead") | F.col(k).eqNullSafe(F.col(f"_w_{k}")))
    hits = known.join(wanted, same).select(*[F.col(f"_w_{k}").alias(k) for k in keys]).distinct()
    return matched(links, hits, keys, "left_anti")


def stop_places(
    listing: DataFrame,
    store: DataFrame,
    key: str,
    order: list[str],
    part: list[str],
    registered: str | None = None,
) -> DataFrame:
    """Place of the first known row of each source, for sources that have one.

    A row is known if its key is in the store, or if an earlier row of this run
    with the same key was registered. ``registered`` names the flag of rows that
    enter the store; without it every row does.
    """
    keys = [*part, key]
    rows = listing.select(*keys, _place(listing, order).alias("_place"), *_flag(registered))
    stored = (
        matched(rows, known_keys(rows, store, keys), keys, "left_semi")
        .groupBy(*part)
        .agg(F.min("_place").alias("_stop"))
    )
    if registered is None:
        # Rank 2 within a key is its first repeat. Spark limits the rank on the map
        # side, so at most two rows per key and task are shuffled.
        oldest = W.partitionBy(*keys).orderBy("_place")
        again = (
            rows.withColumn("_rank", F.row_number().over(oldest))
            .filter(F.col("_rank") == 2)
            .groupBy(*part)
            .agg(F.min("_place").alias("_stop"))
        )
    else:
        first = (
            rows.filter("_registered")
            .groupBy(*keys)
            .agg(F.min("_place").alias("_first"))
        )
        again = (
            matched(rows, first, keys, "inner")
            .filter(F.col("_place") > F.col("_first"))
            .groupBy(*part)
            .agg(F.min("_place").alias("_stop"))
        )
    return stored.unionByName(again).groupBy(*part).agg(F.min("_stop").alias("_stop"))


def _flag(registered: str | None) -> list[Column]:
    flag = F.lit(True) if registered is None else F.col(registered)
    return [flag.alias("_registered")]


def take_until_known(
    listing: DataFrame,
    store: DataFrame | None,
    key: str,
    order: list[str],
    part: list[str],
    mode: str = "strict",
    registered: str | None = None,
) -> DataFrame:
    """Rows of each source before its first known one.

    ``strict`` stops at a stored key or a repeat within the run. ``first-load``
    never stops for a source that has no store yet; the last row of a key wins.
    The store's first load is told by the source having no stored row, or by
    ``store`` being ``None``.
    """
    if mode not in ("strict", "first-load"):
        raise ValueError(mode)
    if store is None:
        if mode == "first-load":
            return last_per_key(listing, [*part, key], order)
        store = listing.select(*part, key).limit(0)
    stops = stop_places(listing, store, key, order, part, registered)
    rows = listing.withColumn("_place", _place(listing, order))
    rows = with_cursor(rows, stops, part)
    before = F.col("_stop").isNull() | (F.col("_place") < F.col("_stop"))
    if mode == "strict":
        return rows.filter(before).select(*listing.columns)
    loaded = store.select(*part).distinct().withColumn("_loaded", F.lit(True))
    rows = with_cursor(rows, loaded, part).filter(F.col("_loaded").isNull() | before)
    return last_per_key(rows.select(*listing.columns), [*part, key], order)


def with_cursor(rows: DataFrame, facts: DataFrame, part: list[str]) -> DataFrame:
    """Rows with what ``facts`` holds for their cursor, one row per cursor.

    Cursors are few and some have very many rows. The rows of one are spread over
    ``SPREAD`` keys and the facts repeated for each, so that the join is even also when
    Spark doesn't broadcast the facts.
    """
    spread = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(SPREAD))
    copies = facts.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    keyed = rows.withColumn("_spread", spread.cast("int"))
    return matched(keyed, copies, [*part, "_spread"], "left").drop("_spread")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order.

    The filter on the rank lets Spark keep one row per key and map task before
    the shuffle, so copies of a hot key never meet in one task.
    """
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    oldest = W.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(oldest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def upsert(
    store: DataFrame, batch: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Store with the batch written over it; the last write of a key wins.

    The store holds one row per key. Its rows are only tested against the keys of
    the batch, so a small batch is broadcast and a big store is not shuffled.
    """
    if not order:
        raise ValueError("the last write of a key needs an order")
    newest = last_per_key(batch, keys, order)
    kept = matched(store, newest, keys, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def upsert_fields(
    store: DataFrame,
    batch: DataFrame,
    keys: list[str],
    fields: list[str],
    order: list[str],
) -> DataFrame:
    """Like ``upsert``, but a stored row only has ``fields`` replaced."""
    newest = last_per_key(batch, keys, order)
    new = newest.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(f).alias(f"_new_{f}") for f in fields],
        F.lit(True).alias("_hit"),
    )
    same = F.lit(True)
    for k in keys:
        same = same & store[k].eqNullSafe(new[f"_k_{k}"])
    rows = store.join(new, same, "full_outer")
    out = []
    for c in store.columns:
        if c in keys:
            out.append(F.coalesce(c, f"_k_{c}").alias(c))
        elif c in fields:
            out.append(
                F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            )
        else:
            out.append(F.col(c))
    out += [F.col(f"_new_{f}").alias(f) for f in fields if f not in store.columns]
    return rows.select(*out)


def backfill(
    store: DataFrame,
    bodies: DataFrame,
    key: str,
    fields: tuple[str, ...],
    order: list[str] | None = None,
    asked: Column | None = None,
) -> DataFrame:
    """Write fetched fields into the store rows; a fetched null overwrites too.

    Of several bodies of a key the last in ``order`` counts, without one the greatest
    in ``fields``; the store keeps its number of rows. Where ``asked`` is given, only
    store rows for which it holds are written, whatever other rows share their key.
    """
    new = last_per_key(bodies, [key], order or list(fields)).select(
        F.col(key).alias("_key"),
        *[F.col(f).alias(f"_new_{f}") for f in fields],
        F.lit(True).alias("_hit"),
    )
    rows = store.join(new, store[key] == new["_key"], "left")
    out = [F.col(c) for c in store.columns if c not in fields]
    hit = F.col("_hit") if asked is None else F.col("_hit") & asked
    for f in fields:
        old = F.col(f) if f in store.columns else F.lit(None)
        out.append(F.when(hit, F.col(f"_new_{f}")).otherwise(old).alias(f))
    return rows.select(*out)


def needs_body(store: DataFrame, body: str = "body") -> DataFrame:
    """Rows still without a body."""
    if body not in store.columns:
        return store
    return store.filter(F.col(body).isNull())


def pending(
    articles: DataFrame, scores: DataFrame, keys: list[str], value: str | None = None
) -> DataFrame:
    """Articles without a score row; a row whose ``value`` is null or false is no score."""
    done = scores
    if value is not None:
        flag = dict(scores.dtypes)[value] == "boolean"
        done = scores.filter(F.col(value) if flag else F.col(value).isNotNull())
    return matched(articles, done, keys, "left_anti")


def drop_failed(df: DataFrame, required: list[str]) -> DataFrame:
    """Items that lack a required part are skipped, the others go on."""
    return df.na.drop(subset=required)


# What each site does with an answer that is not 200. "page" is a
# listing page, "item" an article page; 404 is named where it differs. No status
# at all means that the request itself failed.
STATUS_POLICY: dict[tuple[str, str], dict[str, str]] = {
    ("ec", "page"): {"other": "next"},
    ("ec", "item"): {"other": "skip"},
    ("eec", "page"): {"other": "next"},
    ("eec", "item"): {"other": "skip"},
    ("nleec", "page"): {"other": "next"},
    ("nleec", "item"): {"404": "dead", "other": "skip", "failed": "dead"},
    ("mercom", "page"): {"other": "parse"},
    ("saur", "page"): {"other": "retry"},
    ("saur", "item"): {"other": "null body"},
    ("pvmag", "page"): {"404": "end", "other": "retry"},
    ("pvmag", "item"): {"other": "null body"},
    ("pvmag_us", "page"): {"404": "end", "other": "retry"},
    ("pvmag_us", "item"): {"other": "null body"},
    ("pvmag_global", "page"): {"404": "end", "other": "retry"},
    ("pvmag_global", "item"): {"other": "null body"},
}


def status_outcome(source: Column, kind: Column, status: Column) -> Column:
    """``ok``, or what the site's policy says about the status."""
    out = F.when(status == 200, "ok")
    for (name, what), policy in STATUS_POLICY.items():
        here = (source == name) & (kind == what)
        failed = policy.get("failed", "raise")
        out = out.when(here & status.isNull(), failed)
        if "404" in policy:
            out = out.when(here & (status == 404), policy["404"])
        out = out.when(here, policy["other"])
    return out


def route_status(
    log: DataFrame, source: str = "source", kind: str = "kind", status: str = "status"
) -> DataFrame:
    """Add ``outcome`` to a fetch log."""
    return log.withColumn(
        "outcome", status_outcome(F.col(source), F.col(kind), F.col(status))
    )


def dead_letters(log: DataFrame, url: str = "url") -> DataFrame:
    """Dead-letter entries of a routed log: the id after a 404, else the URL."""
    gone = log.filter(F.col("outcome") == "dead")
    by_id = F.col("status") == 404
    return gone.select(
        F.when(by_id, F.substring_index(url, "/", -1)).otherwise(F.col(url)).alias(
            "entry"
        ),
        F.when(by_id, "not found").otherwise("request failed").alias("reason"),
    )
