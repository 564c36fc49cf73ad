"""Table schemas and the rules that recognise a table by its columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from harborline import fixed_values as fixed

TEXT, NUMBER, WHOLE, DAY, TIME = StringType(), DoubleType(), LongType(), DateType(), TimestampType()


def struct(**cols) -> StructType:
    return StructType([StructField(n, t) for n, t in cols.items()])


TABLES = {
    "inventory": struct(
        product_id=TEXT, product_name=TEXT, warehouse_id=TEXT, current_stock=NUMBER, safety_stock=NUMBER, reorder_point=NUMBER,
        daily_demand=NUMBER,
    ),
    "sales": struct(product_id=TEXT, date=DAY, daily_sales=NUMBER, region=TEXT),
    "suppliers": struct(supplier_id=TEXT, supplier_name=TEXT, lead_time_days=NUMBER, reliability_score=NUMBER),
    "shipments": struct(
        shipment_id=TEXT, supplier_id=TEXT, product_id=TEXT, shipment_date=DAY, expected_delivery=DAY, actual_delivery=DAY, status=TEXT
    ),
    "warehouses": struct(warehouse_id=TEXT, warehouse_location=TEXT, capacity=NUMBER),
}

STOCK_EVENT = struct(timestamp=TIME, product_id=TEXT, warehouse_id=TEXT, change_type=TEXT, quantity=NUMBER)


@dataclass(frozen=True)
class TableSpec:
    """Where a raw table lies, how its columns are typed and which of them it must have."""

    folder: str
    schema: StructType
    required: list[str] = field(default_factory=list)


# Folders, columns and required columns of the public marketplace data set.
MARKETPLACE = {
    "orders": TableSpec("orders", struct(
        order_id=TEXT, customer_id=TEXT, order_status=TEXT, order_purchase_timestamp=TIME, order_approved_at=TIME,
        order_delivered_carrier_date=TIME, order_delivered_customer_date=TIME, order_estimated_delivery_date=TIME,
    ), [
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ]),
    "items": TableSpec("items", struct(
        order_id=TEXT, order_item_id=WHOLE, product_id=TEXT, seller_id=TEXT, shipping_limit_date=TIME, price=NUMBER, freight_value=NUMBER,
    ), ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"]),
    "reviews": TableSpec("reviews", struct(
        review_id=TEXT, order_id=TEXT, review_score=NUMBER, review_creation_date=TIME, review_answer_timestamp=TIME,
    ), ["review_id", "order_id", "review_score"]),
    "sellers": TableSpec("sellers", struct(
        seller_id=TEXT, seller_zip_code_prefix=TEXT, seller_city=TEXT, seller_state=TEXT,
    ), ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]),
    "products": TableSpec("products", struct(product_id=TEXT, product_category_name=TEXT), ["product_id", "product_category_name"]),
    "customers": TableSpec("customers", struct(
        customer_id=TEXT, customer_zip_code_prefix=TEXT, customer_state=TEXT,
    ), ["customer_id", "customer_zip_code_prefix", "customer_state"]),
    "payments": TableSpec("payments", struct(
        order_id=TEXT, payment_type=TEXT, payment_value=NUMBER,
    ), ["order_id", "payment_type", "payment_value"]),
    "geolocation": TableSpec("geolocation", struct(
        geolocation_zip_code_prefix=TEXT, geolocation_lat=NUMBER, geolocation_lng=NUMBER, geolocation_state=TEXT,
    ), ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_state"]),
    "category_translation": TableSpec("category_translation", struct(
        product_category_name=TEXT, product_category_name_english=TEXT,
    ), ["product_category_name", "product_category_name_english"]),
}


def detect_dataset_type(columns: list[str]) -> str:
    """Kind of a table by its header, whatever its case; the first kind that fits wins."""
    have = {c.lower() for c in columns}
    for kind, needed in fixed.DATASET_COLUMNS.items():
        if have.issuperset(needed):
            return kind
    if have.intersection(fixed.GEO_COLUMNS):
        return "geospatial"
    if have.intersection(fixed.TIME_COLUMNS) and have.intersection(fixed.VALUE_COLUMNS):
        return "timeseries"
    return "generic" if have else "unknown"


def schema_match(columns: list[str]) -> str | None:
    """The first expected schema whose columns are all there, header case included."""
    return next((kind for kind, needed in fixed.EXPECTED_COLUMNS.items() if set(needed).issubset(columns)), None)
