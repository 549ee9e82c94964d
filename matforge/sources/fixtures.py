"""Map the driver's TPC-H-style tables onto the procurement inputs.

Each function derives one input of the procurement jobs (line items, predictions,
vendor catalogue, requests, change feed, scoring pairs, result pages) from the
given tables, so every job's work grows with them. The mapping itself is data:
see FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matforge.sources.tables import table


def _money(c: Column, prefix: str = "$ ") -> Column:
    return F.concat(F.lit(prefix), c.cast("decimal(18,2)").cast("string"))


def _mdy(c: Column) -> Column:
    return F.date_format(c, "MM/dd/yyyy")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (dirty, all-text) line items: lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation ⋈ region."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax",
        "l_returnflag", "l_shipdate")
    # completion date = last shipment of the order; the window partitions on the join key,
    # so the join with orders below reuses the same shuffle.
    li = li.withColumn("end_ts", F.max("l_shipdate").over(Window.partitionBy("l_orderkey")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))  # 25 rows
    r = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))  # 5 rows
    # A part's texts are made once for the part, not for each of its lines.
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.col("p_size").cast("string").alias("p_size"), _money(F.col("p_retailprice")).alias("p_price"))
    # Customers meet the orders, of which there are fewer: the lines are not dealt by customer as well. They carry the nation's number; its names
    # come last, without a shuffle.
    o = o.join(c, o.o_custkey == c.c_custkey)
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    j = j.join(n, j.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    pk = F.col("l_partkey").cast("string")
    ln = F.col("l_linenumber")
    return j.select(
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string")).alias("PROJECTNUMBER"),
        F.col("n_name").alias("PROJECT_CITY"),
        F.col("c_mktsegment").alias("PROJECT_TYPE"),
        F.col("r_name").alias("CORE_MARKET"),
        F.col("p_type").alias("UOM"),
        F.when(ln % 3 == 0, F.concat(pk, F.lit(".0"))).otherwise(pk).alias("MasterItemNo"),
        F.when(ln == 7, F.lit(None).cast("string"))
         .when(ln % 4 == 0, F.concat(F.upper("p_name"), F.lit(" - "), F.col("p_type")))
         .otherwise(F.concat(F.col("p_name"), F.lit(" - "), F.col("p_type"))).alias("ItemDescription"),
        F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" EA")).alias("QtyShipped"),
        F.when(ln == 1, F.lit("0")).otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("ExtendedQuantity"),
        _money(F.col("l_extendedprice")).alias("ExtendedPrice"),
        F.col("p_price").alias("UnitPrice"),
        _money(F.col("o_totalprice"), "$").alias("invoiceTotal"),
        F.when(F.col("l_returnflag") == "R", F.lit("-"))
         .otherwise(F.concat(F.col("l_tax").cast("decimal(18,2)").cast("string"), F.lit(" %"))).alias("REVISED_ESTIMATE"),
        (ln - 1).cast("string").alias("NUMFLOORS"),
        F.col("p_size").alias("SIZE_BUILDINGSIZE"),
        F.when(F.col("l_partkey") % 50 == 0, F.lit("not a date")).otherwise(_mdy(F.col("l_shipdate"))).alias("invoiceDate"),
        _mdy(F.col("o_orderdate")).alias("CONSTRUCTION_START_DATE"),
        _mdy(F.col("end_ts")).alias("SUBSTANTIAL_COMPLETION_DATE"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction lines (MasterItemNo, QtyShipped): one per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("MasterItemNo"), F.col("l_quantity").alias("QtyShipped"))


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat vendor table: distinct (part, supplier) pairs; parts with key % 5 = 0 have no vendor."""
    return _vendor_rows(spark, sf_dir).drop("l_partkey")


def _vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor table with the part's number, by which its rows are dealt: what is grouped by it needs no other shuffle."""
    pairs = (table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
             .where(F.col("l_partkey") % 5 != 0).distinct())
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    k = F.col("l_suppkey")
    v = pairs.join(s, pairs.l_suppkey == s.s_suppkey)
    v = v.withColumn("pos", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey")) - 1)
    return v.join(n, F.col("s_nationkey") == n.n_nationkey).select(
        "l_partkey",
        F.col("l_partkey").cast("string").alias("item_key"),
        F.col("pos").cast("int").alias("pos"),
        F.col("s_name").alias("company"),
        F.when(k % 6 != 0, F.concat(F.lit("https://supplier"), k.cast("string"), F.lit(".example.com"))).alias("url"),
        F.lit("supply").alias("services"),
        F.col("n_name").alias("location"),
        F.when(k % 3 != 0, F.concat(F.lit("+91 "), (k + 9000000000).cast("string"))).alias("contact"),
        F.when(k % 40 != 0, k % 40).cast("int").alias("lead_time_days"),
        (k % 7 + 1).cast("int").alias("min_order_qty"),
        F.when(k % 4 == 0, F.lit("Import desk")).otherwise(F.lit("local")).alias("source"),
    )


def vendor_catalogue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per item, ``{"MasterItemNo": .., "vendors": [..]}``.

    Keys of items divisible by 7 are written as text with a '.0' suffix to exercise
    key canonicalisation on read.
    """
    v = _vendor_rows(spark, sf_dir)
    vend = F.struct("company", "url", "services", "location", "contact", "lead_time_days", "min_order_qty", "source")
    nested = v.groupBy("l_partkey", "item_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("pos"), vend.alias("v")))).alias("vs"))
    k = F.col("item_key")
    key_json = F.when(k.cast("bigint") % 7 == 0, F.concat(F.lit('"'), k, F.lit('.0"'))).otherwise(k)
    return nested.select(F.concat(F.lit('{"MasterItemNo":'), key_json, F.lit(',"vendors":'),
                                  F.to_json(F.transform("vs", lambda x: x["v"])), F.lit("}")).alias("value"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procurement requests, one per order (typed columns as a JSON file would give them)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    item = (F.when(k % 4 == 0, F.concat(F.lit("Item "), ck.cast("string")))
            .when(k % 4 == 1, ck.cast("string"))
            .when(k % 4 == 2, F.concat(ck.cast("string"), F.lit(".0")))
            .otherwise(F.format_number(ck, 0)))
    qty = (F.when(k % 13 == 0, F.lit(""))
           .when(k % 5 == 0, F.format_number(F.floor("o_totalprice"), 0))
           .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    status = (F.when(F.col("o_orderstatus") == "F", F.lit(" Approved "))
              .when(F.col("o_orderstatus") == "O", F.lit("Pending"))
              .when(F.col("o_orderstatus") == "P", F.lit("rejected")))
    return o.select(
        k.alias("id"), item.alias("item"), qty.alias("qty"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("needed_by"),
        F.concat(F.lit("order "), k.cast("string")).alias("notes"),
        status.alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        (k % 3 == 0).alias("linked_to_procurement"),
    )


def requests_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON documents in the accepted shapes: object, object of objects, {requests:[..]}, [..], {data:[..]}."""
    r = requests(spark, sf_dir)
    obj = F.to_json(F.struct(*[F.col(c) for c in r.columns]))
    k = F.when(F.col("id") % 5 == 4, F.lit(4)).otherwise(F.col("id") % 4)
    doc = (F.when(k == 0, obj)
           .when(k == 4, F.concat(F.lit('{"first":'), obj, F.lit(',"note":"x"}')))
           .when(k == 1, F.concat(F.lit('{"requests":['), obj, F.lit("]}")))
           .when(k == 2, F.concat(F.lit("["), obj, F.lit("]")))
           .otherwise(F.concat(F.lit('{"data":['), obj, F.lit("]}"))))
    return r.select(doc.alias("value"))


def request_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request status change log from ``events``: purchase -> Approved, error -> Rejected, else Pending."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    status = (F.when(F.col("event_type") == "purchase", F.lit("Approved"))
              .when(F.col("event_type") == "error", F.lit("Rejected")).otherwise(F.lit("Pending")))
    return e.select(F.col("user_id").alias("id"), F.col("ts"), F.col("event_id").alias("seq"), status.alias("status"))


def last_event(spark: SparkSession, sf_dir: str) -> int:
    """The largest event number."""
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]


def score_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(truth, predictions) over orders: label = priority, quantity = total price.

    Predictions shift the label by customer and predict the customer's median price;
    orders with key % 10 = 9 have no prediction (the inner join drops them).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    truth = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("MasterItemNo"),
                     F.col("o_totalprice").alias("QtyShipped"))
    med = o.groupBy("o_custkey").agg(F.median("o_totalprice").alias("med"))
    ck = F.col("o_custkey")
    label = (F.when(ck % 3 == 0, F.lit("1-URGENT")).when(ck % 3 == 1, F.col("o_orderpriority"))
             .otherwise(F.lit("5-LOW")))
    pred = (o.where(F.col("o_orderkey") % 10 != 9).join(med, "o_custkey")
            .select(F.col("o_orderkey").alias("id"), label.alias("MasterItemNo"), F.col("med").alias("QtyShipped")))
    return truth, pred


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored search-result pages: page 2k is the primary provider's page for item k, 2k+1 the secondary's."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html",
                    (F.col("page_id") / 2).cast("bigint").cast("string").alias("item_key"),
                    F.when(F.col("page_id") % 2 == 0, F.lit(1)).otherwise(F.lit(2)).alias("provider_rank"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages with blocks, made of the links of each page: nested boxes with a heading, a place and contacts.

    Pages with key % 4 = 1 have another block class, with key % 4 = 2 no link in a block (name and text only), and with key % 4 = 3
    a block that is never closed; all have boxes that are no blocks.
    """
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    cls = F.when(k % 4 == 1, F.lit("listingBox wide")).otherwise(F.lit("x row"))
    name = F.when(k % 4 == 2, F.lit("$2 - offers")).otherwise(F.lit("<h3><a href=\"$1\">$2</a></h3>"))
    more = F.concat(F.lit("</div><div class='city'>"), F.substring(F.regexp_extract("url", "^https?://([^/?#]+)", 1), 1, 12), F.lit("</div> Tel 80"), F.lpad(k.cast("string"), 7, "0"),
                    F.lit(" sales"), k.cast("string"), F.lit("@example.com"))
    block = F.concat(F.lit('<div class="'), cls, F.lit('"><div>'), name, more, F.when(k % 4 != 3, F.lit("</div>")).otherwise(F.lit("")))
    return p.select("page_id", "url", F.regexp_replace("html", F.lit('<li><a href="([^"]*)">([^<]*)</a></li>'), block).alias("html"))
