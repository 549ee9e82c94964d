"""Run parameters shared by the operators.

No operator reads the wall clock: every date is derived from ``as_of`` or from
the data, so a job is reproducible when it is re-run after an executor loss.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Default project phases: (name, first day offset, last day offset) from as_of.
DEFAULT_PHASES = (
    ("Design & Planning", 0, 20),
    ("Foundation & Civil Works", 21, 50),
    ("Electrical & HVAC", 51, 80),
    ("IT Infrastructure", 81, 95),
    ("Commissioning & Handover", 96, 110),
)

# Phase used when no keyword matches (when that phase exists in the schedule).
DEFAULT_PHASE = "Electrical & HVAC"

# Keyword lists used when aligning purchases with the schedule, in priority order.
SCHEDULE_PHASE_KEYWORDS = (
    ("Electrical & HVAC", ("cable", "tray", "transformer", "breaker", "cable tray", "hvac", "duct", "mcb", "panel")),
    ("IT Infrastructure", ("server", "rack", "network", "switch", "fiber", "rack", "server rack")),
    ("Foundation & Civil Works", ("cement", "steel", "rebar", "concrete", "brick", "block", "mortar")),
    ("Design & Planning", ("survey", "drawing", "design")),
    ("Commissioning & Handover", ("commission", "handover", "testing")),
)

# Keyword lists used by the procurement plan, in priority order.
PLAN_PHASE_KEYWORDS = (
    ("Electrical & HVAC", ("cable", "tray", "transformer", "breaker", "panel", "hvac", "duct")),
    ("IT Infrastructure", ("server", "rack", "network", "fiber", "switch")),
    ("Foundation & Civil Works", ("cement", "concrete", "steel", "rebar", "brick", "block", "mortar")),
)

# Order-cycle labels and risk / mitigation texts of the plan.
CYCLE_STAGED = "Multiple orders (staged deliveries)"
CYCLE_TWO_STAGE = "Consider 2-stage procurement"
CYCLE_SINGLE = "Single order"
RISK_NO_VENDOR = "No vendor in DB — sourcing risk"
MITIGATION_NO_VENDOR = "Identify alternate vendors; consider higher safety stock; allow longer lead time"
RISK_LONG_LEAD = "Long supplier lead time"
MITIGATION_LONG_LEAD = "Pre-book orders; negotiate faster lead time or local stocking"
RISK_IMPORT = "Import dependency"
MITIGATION_IMPORT = "Account for customs and transport delays; increase safety stock"

# Placeholder vendor of the schedule alignment.
PLACEHOLDER_COMPANY = "Placeholder Vendor"
PLACEHOLDER_SOURCE = "placeholder"
TBD_VENDOR = "TBD"
UNKNOWN_VENDOR = "Unknown Vendor"

# Labels of the timeline rows.
PHASE_RESOURCE = "Project Phase"
PHASE_TYPE = "Phase"
PROCUREMENT_TYPE = "Procurement"
TASK_PREFIX = "Procure: "

# Columns cleaned by the line-item preprocessing.
CURRENCY_COLUMNS = ("invoiceTotal", "UnitPrice", "ExtendedPrice", "REVISED_ESTIMATE")
QUANTITY_COLUMNS = ("QtyShipped", "ExtendedQuantity", "NUMFLOORS", "NUMROOMS", "NUMBEDS", "SIZE_BUILDINGSIZE", "MW")
DATE_COLUMNS = ("invoiceDate", "CONSTRUCTION_START_DATE", "SUBSTANTIAL_COMPLETION_DATE")
CATEGORICAL_COLUMNS = ("PROJECT_CITY", "PROJECT_TYPE", "CORE_MARKET", "UOM")

# Raw line-item columns (all read as text; they carry currency signs and units).
LINE_ITEM_COLUMNS = (
    "id", "MasterItemNo", "ItemDescription", "QtyShipped", "UOM", "PROJECTNUMBER", "PROJECT_CITY",
    "PROJECT_TYPE", "CORE_MARKET", "SIZE_BUILDINGSIZE", "NUMFLOORS", "NUMROOMS", "NUMBEDS", "MW",
    "invoiceDate", "CONSTRUCTION_START_DATE", "SUBSTANTIAL_COMPLETION_DATE", "invoiceTotal",
    "UnitPrice", "ExtendedPrice", "ExtendedQuantity", "REVISED_ESTIMATE",
)

# Date text formats tried in order (month first).
DATE_FORMATS = ("MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM-dd-yyyy",
                "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ssXXX",
                "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm", "yyyy/MM/dd", "M/d/yyyy H:mm",
                "M/d/yy")

# Score weights: accuracy, macro F1, regression score.
SCORE_WEIGHTS = (0.25, 0.25, 0.5)


@dataclass(frozen=True)
class PlanConfig:
    """Parameters of the procurement jobs (defaults mirror the reference run)."""

    as_of: _dt.date = _dt.date(1998, 1, 1)
    tasks_default_lead: int = 14          # first-vendor policy, no lead given
    tasks_min_lead: int = 7               # the task window is at least this long
    design_days: int = 30
    procurement_days: int = 60
    schedule_placeholder_lead: int = 14   # placeholder vendor in the schedule
    schedule_default_lead: int = 21       # a real vendor without a lead time
    plan_default_lead: int = 21
    buffer_days: int = 3
    safety_stock_pct: float = 0.10
    min_order_qty: int = 1
    long_lead_days: int = 30
    two_stage_above: int = 100
    staged_above: int = 1000
    phases: tuple = DEFAULT_PHASES
    schedule_keywords: tuple = SCHEDULE_PHASE_KEYWORDS
    plan_keywords: tuple = PLAN_PHASE_KEYWORDS
    default_phase: str = DEFAULT_PHASE
    extra: dict = field(default_factory=dict)
