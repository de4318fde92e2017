"""What each raw table must be: key, required columns, least rows, where it comes from."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    """The contract of one raw table. ``source`` is files, snapshot (one partition a run) or topic."""

    name: str
    key: str
    required: tuple[str, ...]
    source: str = "files"
    min_rows: int = 1
    merge_schema: bool = False


#: Keys, required columns and least rows of the eight contracts.
SPECS = {
    s.name: s
    for s in (
        TableSpec("raw_orders", "order_id", ("order_id", "customer_id", "restaurant_id", "order_time", "status"), min_rows=1000),
        TableSpec("raw_order_items", "order_item_id", ("order_item_id", "order_id", "menu_item_id", "quantity"), min_rows=1000),
        TableSpec("raw_menu_items", "menu_item_id", ("menu_item_id", "restaurant_id", "price"), min_rows=100, merge_schema=True),
        TableSpec("raw_reviews", "review_id", ("review_id", "order_id", "rating"), min_rows=100),
        TableSpec("raw_customers", "customer_id", ("customer_id", "city", "segment"), "snapshot", 100),
        TableSpec("raw_restaurants", "restaurant_id", ("restaurant_id", "city", "category"), "snapshot", 100),
        TableSpec("raw_drivers", "driver_id", ("driver_id", "vehicle_type", "city"), "snapshot", 100),
        TableSpec("raw_delivery_events", "event_id", ("event_id", "order_id", "event_type", "event_time", "sent_at"), "topic", 100),
    )
}
