"""Names the event platform and the dashboards agree on."""

from __future__ import annotations

# The publishing domains, and the event types each one emits.
EVENT_TYPES_BY_DOMAIN: dict[str, tuple[str, ...]] = {
    "order": (
        "OrderCreated",
        "OrderConfirmed",
        "OrderCancelled",
        "OrderCompensationTriggered",
        "OrderDelivered",
    ),
    "inventory": (
        "InventoryReserved",
        "InventoryReleased",
        "InventoryReservationFailed",
        "InventoryReplenished",
    ),
    "payment": ("PaymentCompleted", "PaymentFailed", "RefundIssued", "ChargebackReceived"),
    "shipping": ("ShipmentDispatched", "ShipmentCreationFailed"),
    "delivery-tracking": ("DeliveryStatusUpdated",),
    "product": ("ProductCreated", "ProductPriceChanged", "ProductUpdated"),
    "review": ("ReviewSubmitted", "ReviewUpdated"),
    "category": ("CategoryUpdated",),
    "offer": ("CouponRedeemed", "PriceQuoteIssued", "PromotionActivated", "PromotionDeactivated"),
    "user": ("UserProfileUpdated", "UserDataErased"),
    "identity": ("UserRegistered", "SessionCreated", "UserAccountUpdated"),
    "notification": ("NotificationSent",),
    "cart": ("CartCheckedOut",),
    "wishlist": ("WishlistPriceAlertTriggered",),
    "admin": ("AdminActionPerformed",),
}

# Event types whose payload names an end user.
PII_EVENT_TYPES = (
    "OrderCreated",
    "ReviewSubmitted",
    "UserProfileUpdated",
    "UserDataErased",
    "UserRegistered",
    "SessionCreated",
    "UserAccountUpdated",
    "NotificationSent",
    "CartCheckedOut",
    "WishlistPriceAlertTriggered",
)

# Top-level payload fields an erasure blanks, and what it writes there.
PII_FIELDS = ("email", "displayName", "name")
REDACTED = "[redacted]"

# Funnel stages in order; star ratings of the histogram.
FUNNEL_STAGES = (
    "CartCheckedOut",
    "OrderCreated",
    "OrderConfirmed",
    "PaymentCompleted",
    "OrderDelivered",
)
STARS = ("1", "2", "3", "4", "5")

# Bucket sizes, money unit, shape label, defaults.
GRANULARITIES = ("hour", "day", "week", "month")
CURRENCY = "USD"
SCHEMA_VERSION_LABEL = "1.0"
UNKNOWN_PUBLISHER = "unknown"
UNKNOWN_EVENT_TYPE = "Unknown"
ERASURE_EVENT = "UserDataErased"
EMPTY_UUID = "00000000-0000-0000-0000-000000000000"
RETRY_BUDGET = 3

# The principal each job stamps on the rows it writes.
INGESTION_PRINCIPAL = "system:analytics-ingestion-consumer"
DLQ_PRINCIPAL = "system:analytics-dlq-reprocessor"
RECONCILIATION_PRINCIPAL = "system:analytics-reconciliation-job"
REDACTION_PRINCIPAL = "system:analytics-pii-redaction-sweep"


def domain_of(event_type: str) -> str | None:
    for domain, event_types in EVENT_TYPES_BY_DOMAIN.items():
        if event_type in event_types:
            return domain
    return None


def topic_of(domain: str, namespace: str = "commerce") -> str:
    return f"{namespace}.{domain}.events"


def all_topics(namespace: str = "commerce") -> list[str]:
    return [topic_of(domain, namespace) for domain in EVENT_TYPES_BY_DOMAIN]
