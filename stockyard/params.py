"""Business constants. Every operator takes them as keyword defaults."""

from decimal import Decimal

# Tier and status labels, in rank order.
RISK_TIERS = ["Understocked", "Balanced", "High Inventory", "Excess Inventory"]
SHELF_STATUSES = ["Out of Stock", "Below Reorder", "Near Reorder", "Adequate Stock"]
TREND_STATUSES = ["Out of Stock", "Below Reorder Point", "Adequate Stock"]
SEGMENTS = ["Slow-moving", "Medium-moving", "Fast-moving"]
SEASONS = ["Spring", "Summer", "Autumn", "Winter"]

# Tier cuts as multiples of the forecast.
CANONICAL_CUTS = (Decimal("1.0"), Decimal("1.5"), Decimal("2.0"))
NARROW_CUTS = (Decimal("0.75"), Decimal("1.25"), Decimal("1.50"))
OVERSTOCK_FACTOR = Decimal("1.5")
BALANCED_BAND = (Decimal("0.75"), Decimal("1.25"))
NEAR_REORDER_FACTOR = Decimal("0.75")

# Replenishment.
BUFFER = Decimal("1.10")
TRAILING_DAYS = 90
LEAD_TIME_DAYS = 1
SERVICE_Z = 1.65

# Outlier fence, scatter sample, bubble sizes, watchlist length.
IQR_FENCE = 1.5
SAMPLE_ROWS = 4000
SAMPLE_SEED = 42
BUBBLE_RANGE = (200.0, 2000.0)
WATCHLIST_ROWS = 5
