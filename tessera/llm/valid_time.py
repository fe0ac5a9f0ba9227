"""Sales enriched with the version of their client that was valid when they were made, as a stateful stream.

Both tables are cut into batches by arrival and fed in order to one Structured Streaming query. Its state is
kept by slot (the clients of one hash): versions and waiting sales as day pages in a MapState each, and
a directory with the pages, their counts, and of each client and page the number, the first
and the last version. A sale scans the page of its own day, or else takes the last version of the nearest
earlier page from the directory. The horizon H drains pages: what lies below it leaves as emitted sales or as pruned
versions, and pages that it has passed are dropped.

A client with more than a given share of all rows is cut along time into pages that are dealt to lanes,
each a slot of its own. Lanes know the other lanes' pages by the directory alone: rows of counts and
last versions per page, aggregated before they are fed to every lane. What only the page at
the horizon knows (how many of its versions are pruned) its lane tells in a row of its own, which the result adds in."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import drop_written, give_back, new_path, remove_path, small_batches, written

BATCHES, FIRST_DAY, DAYS = 12, 19723, 152
DAY = 86_400_000_000
#: A client with more than this share of all rows is cut into lanes: there can be 200 such clients at most.
HOT_SHARE = 1 / 200
#: ... and more than so many.
HOT_ROWS = 1000
#: Rows of all batches that a slot is made for, and those of a part of the feed and of the state.
SLOT_ROWS, PART_ROWS = 200_000, 2_000_000
NEVER = -(1 << 62)

FEED = "slot bigint, kind int, batch int, client bigint, page bigint, at bigint, id bigint, cents bigint, op string, n bigint, first bigint"
OUT = "rec string, id bigint, batch bigint, n_held bigint, change_id bigint, balance_cents bigint, op string, client bigint"
TICK, SALE, VERSION, HEAD = 0, 1, 2, 3

_VERSION = pa.schema([("client", pa.int64()), ("page", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("cents", pa.int64()), ("op", pa.string())])
_HEAD = pa.schema([*_VERSION, ("n", pa.int64()), ("first", pa.int64())])
_SALE = pa.schema([("client", pa.int64()), ("page", pa.int64()), ("at", pa.int64()), ("id", pa.int64())])
_PAGE = pa.schema([("page", pa.int64()), ("versions", pa.int64()), ("sales", pa.int64())])


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes, schema: pa.Schema) -> pa.Table:
    return pa.ipc.open_stream(data).read_all() if data else schema.empty_table()


def column(table: pa.Table, name: str) -> np.ndarray:
    """Numbers of a column; NEVER stands for null."""
    return table[name].to_numpy()


def in_order(rows: pa.Table) -> pa.Table:
    """Rows by client, time and id; what is equal in these by value and operation, so that no order of arrival matters."""
    return rows.sort_by([(c, "ascending") for c in ("client", "at", "id", "cents", "op")])


def last_of_each(rows: pa.Table, *keys: str) -> np.ndarray:
    """Mask of the last row of each run of equal keys in ordered rows."""
    n = rows.num_rows
    out = np.ones(n, dtype=bool)
    if n > 1:
        out[:-1] = np.any([column(rows, k)[1:] != column(rows, k)[:-1] for k in keys], axis=0)
    return out


def as_of(versions: pa.Table, client: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of ``versions`` (in order) that is its client's last with a time of at most ``at``; -1 if there is none."""
    n = versions.num_rows
    if not n:
        return np.full(len(client), -1, dtype=np.int64)
    every = np.concatenate([column(versions, "client"), client]), np.concatenate([column(versions, "at"), at])
    late = np.concatenate([np.zeros(n, dtype=np.int8), np.ones(len(client), dtype=np.int8)])
    rank = np.concatenate([np.arange(n), np.zeros(len(client), dtype=np.int64)])
    order = np.lexsort((rank, late, every[1], every[0]))
    seen = np.maximum.accumulate(np.where(order < n, order, -1))  # versions are in order, so the last one seen is the largest
    found = np.full(n + len(client), -1, dtype=np.int64)
    found[order] = seen
    found = found[n:]
    ok = found >= 0
    ok[ok] = column(versions, "client")[found[ok]] == client[ok]
    return np.where(ok, found, -1)


class Slot(StatefulProcessor):
    """One slot's part of one batch. ``horizon`` is H, ``late`` the watermark of changes (NEVER: minus infinity);
    the batch after the last one emits what waits."""

    def __init__(self, batch: int, horizon: int, late: int, plain: int, width: int, flush: bool):
        self.batch, self.horizon, self.late, self.plain, self.width, self.flush = batch, horizon, late, plain, width, flush

    def init(self, handle) -> None:
        self.directory = handle.getValueState("directory", "heads binary, pages binary")
        self.versions = handle.getMapState("versions", "page bigint", "rows binary")
        self.sales = handle.getMapState("sales", "page bigint", "rows binary")

    def close(self) -> None:
        give_back()

    def handleInputRows(self, key, rows, timerValues):
        slot = key[0]
        lane = slot >= self.plain  # a part of one hot client's time
        width = self.width if lane else DAY
        new = pa.concat_tables([pa.Table.from_pandas(b[["kind", *_HEAD.names]], schema=pa.schema([("kind", pa.int32()), *_HEAD]), preserve_index=False) for b in rows])
        kind = column(new, "kind")
        held = self.directory.get() if self.directory.exists() else (b"", b"")
        heads, pages = unpack(held[0], _HEAD), {p: [v, s] for p, v, s in zip(*unpack(held[1], _PAGE).to_pydict().values())}

        came = new.filter(pa.array(kind == VERSION)).select(_VERSION.names)
        is_late = column(came, "at") < self.late
        if is_late.any():
            yield self.out("late", came["id"].to_numpy()[is_late], batch=self.batch)
        came = came.filter(pa.array(~is_late & (column(came, "client") != NEVER)))
        self.file(self.versions, came, pages, 0, _VERSION)
        heads = self.noted(heads, new.filter(pa.array(kind == HEAD)).select(_HEAD.names) if lane else self.heads_of(came))

        sold = new.filter(pa.array(kind == SALE)).select(_SALE.names)
        at = column(sold, "at")
        go = (at == NEVER) | (at < self.horizon) | self.flush
        ready = [sold.filter(pa.array(go))]
        self.file(self.sales, sold.filter(pa.array(~go)), pages, 1, _SALE)
        for page in sorted(p for p, (_, n) in pages.items() if n and (self.flush or p * width < self.horizon)):
            waiting = unpack(self.sales.getValue((page,))[0], _SALE)
            go = (column(waiting, "at") < self.horizon) | self.flush
            ready.append(waiting.filter(pa.array(go)))
            self.put(self.sales, page, waiting.filter(pa.array(~go)), pages, 1)
        ready = pa.concat_tables(ready)
        if ready.num_rows:
            yield self.emitted(ready, heads, pages)
        if self.horizon != NEVER and not self.flush:
            heads, told = self.pruned(heads, pages, width, lane)
            if told is not None:
                yield told
        known = {p: n for p, n in pages.items() if n[0] or n[1]}
        self.directory.update((pack(heads), pack(pa.table([list(known), [n[0] for n in known.values()], [n[1] for n in known.values()]], schema=_PAGE))))

    def put(self, state, page: int, rows: pa.Table, pages: dict, which: int) -> None:
        """A page's rows and count; an empty page is dropped."""
        if rows.num_rows:
            state.updateValue((page,), (pack(rows),))
        elif pages.get(page, [0, 0])[which]:
            state.removeKey((page,))
        pages.setdefault(page, [0, 0])[which] = rows.num_rows

    def file(self, state, rows: pa.Table, pages: dict, which: int, schema: pa.Schema) -> None:
        """Adds rows to the pages that they are of."""
        at = column(rows, "page")
        order = np.argsort(at, kind="stable")
        rows, at = rows.take(pa.array(order)), at[order]
        starts = np.flatnonzero(np.diff(at, prepend=at[:1] - 1)) if len(at) else []
        for a, b in zip(starts, [*starts[1:], len(at)]):
            page, more = int(at[a]), rows.slice(a, b - a)
            if pages.get(page, [0, 0])[which]:
                more = pa.concat_tables([unpack(state.getValue((page,))[0], schema), more])
            self.put(state, page, more.combine_chunks(), pages, which)

    def heads_of(self, rows: pa.Table) -> pa.Table:
        """Number, first and last version by client and page."""
        rows = in_order(rows)
        last = np.flatnonzero(last_of_each(rows, "client", "page"))
        first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
        return rows.take(pa.array(last)).append_column("n", pa.array(last - first + 1, pa.int64())).append_column("first", rows["at"].take(pa.array(first)))

    def noted(self, heads: pa.Table, more: pa.Table) -> pa.Table:
        """Heads of client and page with those of the batch added."""
        if not more.num_rows:
            return heads
        both = in_order(pa.concat_tables([heads, more.cast(_HEAD)]))
        last = np.flatnonzero(last_of_each(both, "client", "page"))
        first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
        out = both.take(pa.array(last))
        n, begin = np.add.reduceat(column(both, "n"), first), np.minimum.reduceat(column(both, "first"), first)
        return out.set_column(6, "n", pa.array(n)).set_column(7, "first", pa.array(begin))

    def emitted(self, ready: pa.Table, heads: pa.Table, pages: dict) -> pd.DataFrame:
        """Sales with their version: from the page of their own day, else the directory's last one before."""
        client, at = column(ready, "client"), column(ready, "at")
        own = [unpack(self.versions.getValue((int(p),))[0], _VERSION) for p in np.unique(column(ready, "page")[at != NEVER]) if pages.get(int(p), [0, 0])[0]]
        known = in_order(pa.concat_tables([*own, heads.select(_VERSION.names)]))
        found = np.where((at == NEVER) | (client == NEVER), -1, as_of(known, client, at))
        who, n = np.unique(column(heads, "client"), return_inverse=True)
        count = np.bincount(n, weights=column(heads, "n"), minlength=len(who)).astype(np.int64)
        place = np.searchsorted(who, client)
        held = np.where(np.append(who, NEVER)[place] == client, np.append(count, 0)[place], 0) if len(who) else np.zeros(len(client), dtype=np.int64)
        version = known.take(pa.array(found, mask=found < 0))
        return self.out("sale", ready["id"], n_held=held, change_id=version["id"], balance_cents=version["cents"], op=version["op"], client=ready["client"], batch=self.batch)

    def pruned(self, heads: pa.Table, pages: dict, width: int, lane: bool) -> tuple[pa.Table, pd.DataFrame | None]:
        """Of each client's versions up to the horizon all but the last go; pages that it has passed are dropped."""
        edge = self.horizon // width
        for page in [p for p, (n, _) in pages.items() if n and p < edge]:
            self.put(self.versions, page, _VERSION.empty_table(), pages, 0)
        told = None
        if pages.get(edge, [0, 0])[0]:
            rows = in_order(unpack(self.versions.getValue((edge,))[0], _VERSION))
            passed = column(rows, "at") <= self.horizon
            client = column(rows, "client")
            same = np.append(client[1:] == client[:-1], False) & np.append(passed[1:], False)
            stay = ~passed | ~same  # the last one up to the horizon stays
            self.put(self.versions, edge, rows.filter(pa.array(stay)), pages, 0)
            who, n = np.unique(client[stay], return_counts=True)
            now = dict(zip(who.tolist(), n.tolist()))
            at_edge = column(heads, "page") == edge
            if lane:
                # other lanes count all of this page; the next batch's sales have to know
                for c, n in zip(column(heads, "client")[at_edge].tolist(), column(heads, "n")[at_edge].tolist()):
                    if n > now.get(c, 0):
                        told = self.out("less", np.array([n - now.get(c, 0)]), batch=self.batch + 1, client=np.array([c]))
            else:
                n = np.array([now.get(c, 0) if e else n for c, n, e in zip(column(heads, "client").tolist(), column(heads, "n").tolist(), at_edge.tolist())], dtype=np.int64)
                heads = heads.set_column(6, "n", pa.array(n, pa.int64()))
        page, client, first = column(heads, "page"), column(heads, "client"), column(heads, "first")
        based = np.unique(client[(page == edge) & (first <= self.horizon)])  # their last version up to H is in the page at H
        before = page < edge
        last_before = before & np.append((client[1:] != client[:-1]) | ~before[1:], True)[: len(client)]
        heads = heads.set_column(6, "n", pa.array(np.where(last_before, 1, column(heads, "n")), pa.int64()))
        return heads.filter(pa.array(~before | (last_before & ~np.isin(client, based)))), told

    @staticmethod
    def out(rec: str, ids, **columns) -> pd.DataFrame:
        n = len(ids)
        null = lambda a: pc.if_else(pc.equal(a, NEVER), pa.scalar(None, pa.int64()), a)
        ints = {c: columns.get(c) for c in ("batch", "n_held", "change_id", "balance_cents", "client")} | {"id": ids}
        made = {c: pa.nulls(n, pa.int64()) if v is None else pa.array([v] * n, pa.int64()) if isinstance(v, int) else null(pa.array(v, pa.int64()) if isinstance(v, np.ndarray) else v) for c, v in ints.items()}
        made |= {"rec": pa.array([rec] * n, pa.string()), "op": columns.get("op", pa.nulls(n, pa.string()))}
        names = [f.split()[0] for f in OUT.split(", ")]
        return pa.table({c: made[c] for c in names}).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    second = F.date_part(F.lit("SECOND"), at)
    return F.unix_date(at.cast("date")).cast("long") * DAY + F.hour(at).cast("long") * 3_600_000_000 + F.minute(at).cast("long") * 60_000_000 + (second * 1_000_000).cast("long")


def batch_of(day: Column, batches: int, first_day: int, days: int) -> Column:
    """Number of the batch of a day since 1970; earlier days are of the first batch, later ones and null of the last."""
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first_day) * batches / F.lit(days)))).cast("int")


def watermarks(sales: DataFrame, versions: DataFrame, batches: int) -> tuple[list[int], list[int]]:
    """(H, watermark of changes) by batch: the largest times of the batches before. A row a batch comes to the driver."""
    tops = []
    for df in (sales, versions):
        top = {r[0]: r[1] for r in df.groupBy("batch").agg(F.max("at")).collect()}
        mark, out = NEVER, []
        for b in range(batches):
            out.append(mark)
            mark = max(mark, NEVER if top.get(b) is None else top[b])
        tops.append([*out, mark])
    return [min(a, b) for a, b in zip(*tops)], tops[1]


def enrich_sales(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, first_day: int = FIRST_DAY, days: int = DAYS, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows ``rec`` (sale or late), ``id``, ``batch``; of sales ``n_held``, ``change_id``, ``balance_cents``, ``op``.

    Sales of no client hold no version, those without a time take none and are emitted at once. Changes without a time are
    ignored; those of no client are late or nothing. Rows of changes that are equal in all columns named
    here are one. Of versions equal in time and id the one with the larger balance, then operation, counts as the last; a balance that is
    no finite number gives null cents. Sales that repeat an id are emitted each. Without rows there is no row."""
    spark = sales.sparkSession
    root = new_path(spark, "valid-time")
    key = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
    sold = sales.select(
        batch_of(F.unix_date(F.col("arrived_at").cast("date")), batches, first_day, days).alias("batch"), F.col("client_id").cast("long").alias("client"), micros(F.col("sold_at")).alias("at"), F.col("sale_id").cast("long").alias("id")
    )
    balance = F.col("balance").cast("double")
    day = F.unix_date(F.col("valid_at").cast("date")) + F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary")) % 4
    versions = (
        changes.select(*[c for c in key if c in changes.columns]).where("valid_at is not null").distinct()
        .select(batch_of(day, batches, first_day, days).alias("batch"), F.col("client_id").cast("long").alias("client"), micros(F.col("valid_at")).alias("at"), F.col("change_id").cast("long").alias("id"), F.when(F.abs(balance) < 9e15, F.floor(100 * balance + 0.5)).cast("long").alias("cents"), "op")
    )
    versions = written(versions, "versions")
    horizon, late = watermarks(sold, versions, batches)
    by_client = sold.select("client").unionByName(versions.select("client")).groupBy("client").agg(F.count("*").alias("rows"))
    total, hot = by_client.agg(F.sum("rows")).first()[0] or 0, []
    if total:  # at most 1 / hot_share clients
        hot = [(i, r.client, r.rows) for i, r in enumerate(by_client.where((F.col("rows") > total * hot_share) & F.col("client").isNotNull() & (F.col("rows") > hot_rows)).orderBy("client").collect())]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_ROWS))
    plain = max(4 * parts, -(-total // SLOT_ROWS))
    lanes = max(16, int(max((r for *_, r in hot), default=0) / batches) ** 0.5 // 4)
    lanes, width = int(lanes), int(-(-days * DAY // batches) // int(lanes)) + 1
    lanes_of_hot = spark.createDataFrame([(c, i) for i, c, _ in hot], "client bigint, hot int")

    def dealt(df: DataFrame, own: Column) -> DataFrame:
        """``df`` with slot and page; a row without a client or, of a hot one, without a time goes by its own id."""
        page = F.when(F.col("hot").isNull(), F.expr(f"(at - pmod(at, {DAY})) div {DAY}")).otherwise(F.expr(f"(at - pmod(at, {width})) div {width}"))
        lane = F.pmod(F.coalesce(F.col("page"), F.xxhash64(own)), F.lit(lanes))
        slot = F.when(F.col("hot").isNotNull(), plain + F.col("hot") * lanes + lane).otherwise(F.pmod(F.xxhash64(F.coalesce("client", own)), F.lit(plain)))
        return df.join(F.broadcast(lanes_of_hot), "client", "left").withColumn("page", page).withColumn("slot", slot)

    marks = F.array(*[F.lit(x) for x in late])
    placed = dealt(versions, F.col("id"))
    told = (
        placed.where("hot is not null").where(F.col("at") >= marks[F.col("batch")]).groupBy("batch", "hot", "client", "page")
        .agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max(F.struct("at", "id", "cents", "op")).alias("last"))
        .select("batch", "client", "page", "n", "first", "last.*", F.explode(F.sequence(plain + F.col("hot") * lanes, plain + F.col("hot") * lanes + lanes - 1)).alias("slot"))
    )
    ticks = spark.range(plain + len(hot) * lanes).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(batches))).alias("batch"))
    names = {f.split()[0]: f.split()[1] for f in FEED.split(", ")}

    def full(df: DataFrame, kind: int) -> DataFrame:
        value = {c: F.col(c) if c in df.columns else F.lit(None) for c in names} | {"kind": F.lit(kind)}
        # numbers without nulls stay whole numbers on their way through pandas
        return df.select(*[(F.coalesce(value[c].cast(t), F.lit(NEVER)) if t == "bigint" else value[c].cast(t)).alias(c) for c, t in names.items()])

    feed = full(dealt(sold, F.col("id")), SALE).unionByName(full(placed, VERSION)).unionByName(full(told, HEAD)).unionByName(full(ticks, TICK))
    feed.coalesce(parts).write.partitionBy("batch").parquet(f"{root}/staged")  # each part writes a file a batch
    drop_written(versions)

    session = stream_session(spark, parts)
    for b in range(batches + 1):
        publish(spark, f"{root}/staged/batch={b}", f"{root}/feed/batch={b}")
        rows = session.readStream.schema(FEED).parquet(f"{root}/feed")
        found = rows.groupBy("slot").transformWithStateInPandas(Slot(b, horizon[b], late[b], plain, width, b == batches), OUT, "Append", "None")
        run = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    for part in ("staged", "feed", "state"):
        remove_path(spark, f"{root}/{part}")
    return with_told(spark.read.schema(OUT).parquet(f"{root}/out"))


def with_told(out: DataFrame) -> DataFrame:
    """Sales and late changes; held versions of a hot client less those that the lane of its page at the horizon pruned."""
    # at most a row for each hot client and batch
    less = out.where("rec = 'less'").groupBy("client", "batch").agg(F.sum("id").alias("less"))
    rows = out.where("rec <> 'less'").join(F.broadcast(less), ["client", "batch"], "left")
    return rows.select("rec", "id", "batch", (F.col("n_held") - F.coalesce("less", F.lit(0))).alias("n_held"), "change_id", "balance_cents", "op")


def stream_session(spark: SparkSession, parts: int) -> SparkSession:
    """A session of its own with the state store that map states need; the caller's settings stay as they are."""
    session = spark.newSession()
    store = "spark.sql.streaming.stateStore."
    settings = {
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.streaming.minBatchesToRetain": "2",
        store + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        store + "rocksdb.changelogCheckpointing.enabled": "true",
        store + "rocksdb.writeBufferSizeMB": "4",
        store + "unloadOnCommit": "true",  # a start feeds one batch, so nothing is gained by open stores
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        store + "minDeltasForSnapshot": "1000",  # a run has few batches, and its state goes with it
    }
    for k, v in settings.items():
        session.conf.set(k, v)
    small_batches(session)
    return session


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Moves a written batch to where the stream looks, in one step."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target).getParent())
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {source} to {target}")
