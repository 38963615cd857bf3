"""The shop schema: twelve tables with their keys, as declared types."""

from cartulary import Constraints, ForeignKey

# Column names and types of the twelve tables; * marks required columns.
SCHEMA = {
    "users": "user_id*:integer full_name*:varchar(100) email*:varchar(150) "
    "phone_number:varchar(15) city:varchar(50) state:varchar(50) pincode:varchar(10) "
    "is_verified:boolean is_premium:boolean created_at:timestamp updated_at:timestamp",
    "addresses": "address_id*:integer user_id:integer address_line1:varchar(200) "
    "address_line2:varchar(200) city:varchar(50) state:varchar(50) pincode:varchar(10) "
    "address_type:varchar(20) is_default:boolean created_at:timestamp",
    "categories": "category_id*:integer category_name*:varchar(100) parent_id:integer "
    "description:text is_active:boolean created_at:timestamp",
    "products": "product_id*:integer category_id:integer product_name*:varchar(200) "
    "brand:varchar(100) description:text price*:numeric(10,2) mrp:numeric(10,2) "
    "stock_qty:integer sku:varchar(50) is_active:boolean created_at:timestamp",
    "orders": "order_id*:integer user_id:integer order_status:varchar(30) "
    "total_amount:numeric(10,2) discount_amt:numeric(10,2) tax_amount:numeric(10,2) "
    "payment_status:varchar(20) shipping_addr:text ordered_at:timestamp delivered_at:timestamp",
    "order_items": "item_id*:integer order_id:integer product_id:integer quantity*:integer "
    "unit_price:numeric(10,2) discount_pct:float total_price:numeric(10,2) created_at:timestamp",
    "payments": "payment_id*:integer order_id:integer payment_method:varchar(30) "
    "payment_status:varchar(20) amount:numeric(10,2) transaction_id:varchar(100) "
    "gateway:varchar(50) paid_at:timestamp created_at:timestamp",
    "shipments": "shipment_id*:integer order_id:integer carrier:varchar(50) "
    "tracking_no:varchar(100) status:varchar(30) estimated_date:timestamp "
    "delivered_date:timestamp created_at:timestamp",
    "reviews": "review_id*:integer product_id:integer user_id:integer rating:integer "
    "title:varchar(200) review_text:text is_verified:boolean helpful_votes:integer "
    "created_at:timestamp",
    "inventory": "inventory_id*:integer product_id:integer warehouse:varchar(100) "
    "qty_available:integer qty_reserved:integer qty_damaged:integer reorder_level:integer "
    "last_restocked:timestamp updated_at:timestamp",
    "coupons": "coupon_id*:integer coupon_code*:varchar(30) discount_type:varchar(20) "
    "discount_value:float min_order_amt:numeric(10,2) max_uses:integer used_count:integer "
    "valid_from:timestamp valid_until:timestamp is_active:boolean created_at:timestamp",
    "user_events": "event_id*:bigint user_id:integer session_id:varchar(100) "
    "event_type:varchar(50) page_url:varchar(300) product_id:integer device_type:varchar(20) "
    "os:varchar(30) city:varchar(50) created_at:timestamp",
}
# Table, column, referenced table, referenced column.
REFERENCES = (
    ("addresses", "user_id", "users", "user_id"),
    ("categories", "parent_id", "categories", "category_id"),
    ("products", "category_id", "categories", "category_id"),
    ("orders", "user_id", "users", "user_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("shipments", "order_id", "orders", "order_id"),
    ("reviews", "product_id", "products", "product_id"),
    ("reviews", "user_id", "users", "user_id"),
    ("inventory", "product_id", "products", "product_id"),
    ("user_events", "user_id", "users", "user_id"),
)

COLUMNS = {
    table: [tuple(c.split(":", 1)) for c in text.split()] for table, text in SCHEMA.items()
}
CONSTRAINTS = Constraints(
    {t: (cols[0][0].rstrip("*"),) for t, cols in COLUMNS.items()},
    tuple(ForeignKey(t, (c,), r, (k,)) for t, c, r, k in REFERENCES),
    {t: tuple(n[:-1] for n, _ in cols if n.endswith("*")) for t, cols in COLUMNS.items()},
)


def raw_columns():
    return [
        (table, place, name.rstrip("*"), kind, not name.endswith("*"), None)
        for table, cols in COLUMNS.items()
        for place, (name, kind) in enumerate(cols, 1)
    ]
