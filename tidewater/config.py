"""Thresholds and fixed domains shared by every job.

Fixed values below must equal the surveyed application's settings for the
results to match; they are plain constants, not tunables of this engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # --- fixed values (application settings) ---
    max_input_length: int = 1000
    default_row_limit: int = 100
    confidence_threshold: float = 0.7
    low_confidence_threshold: float = 0.4
    unrecognizable_threshold: float = 0.3
    max_file_size_mb: int = 10
    supported_file_types: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg")
    max_conversation_history: int = 10
    max_history_chars: int = 300
    full_scan_row_threshold: int = 1000
    # --- engine knobs (ours) ---
    as_of: str = "2001-08-01"
    extra: dict = field(default_factory=dict)


SETTINGS = Settings()

# --- domains of the logistics fixture (our own) ---
DELAY_REASONS = ["berth_wait", "paperwork", "storm", "missed_transfer", "engine_trouble", "road_closed", "no_chassis", "recount"]
COMMODITIES = ["grain", "timber", "machine_parts", "fresh_fruit", "paper", "glassware", "bicycles", "paint", "toys", "coffee", "tiles", "instruments"]
INCOTERMS = ["CFR", "CIF", "CIP", "CPT", "EXW", "FAS", "FCA", "FOB"]
CONTAINER_TYPES = ["20GP", "40GP", "40HC", "45HC"]
# --- fixed values: event types, in order, that the questions name ---
TRACKING_SEQUENCE = [
    "booked", "picked_up", "departed_origin", "in_transit",
    "arrived_port", "customs_cleared", "out_for_delivery", "delivered",
]

# --- fixed values: expected fields per document type ---
EXPECTED_FIELDS = {
    "invoice": [
        "invoice_number", "invoice_date", "vendor_name", "buyer_name", "total_amount",
        "currency", "tax_amount", "subtotal", "line_items", "payment_terms", "due_date",
        "po_number", "shipment_reference",
    ],
    "bill_of_lading": [
        "bl_number", "shipper_name", "consignee_name", "notify_party", "vessel_name",
        "voyage_number", "port_of_loading", "port_of_discharge", "container_numbers",
        "description_of_goods", "gross_weight", "measurement", "date_of_issue",
        "number_of_packages",
    ],
    "packing_list": [
        "packing_list_number", "date", "shipper", "consignee", "items", "total_packages",
        "total_gross_weight", "total_net_weight", "total_volume",
    ],
    "customs_declaration": [
        "declaration_number", "date", "importer_name", "exporter_name", "country_of_origin",
        "hs_code", "description_of_goods", "quantity", "declared_value", "currency",
        "duty_amount",
    ],
}

# --- fixed values: the seven logistics tables known to the question corpus ---
KNOWN_TABLES = [
    "customers", "carriers", "shipments", "shipment_charges",
    "tracking_events", "invoices", "extracted_documents",
]
