"""Limits of what may be published. They can be made stricter, never weaker."""

from __future__ import annotations

from dataclasses import dataclass

#: Columns that identify a person and may be in no schema. The first list must be refused by name.
PROHIBITED = (
    "user_id", "device_id", "ip_address", "phone_number", "name", "email", "social_media_handle", "biometric_data", "precise_coordinates", "street_address", "license_plate", "mac_address",
    "imei", "advertising_id", "ssn", "account_id",
    "author", "author_id", "username", "user_name", "phone", "address", "full_name", "first_name", "last_name", "lat_exact", "lon_exact", "precise_location",
)


@dataclass(frozen=True)
class Limits:
    """Thresholds of a tier."""

    min_size: int = 3
    min_sources: int = 2
    delay_hours: int = 24
    min_volume: float = 1.0
    min_quality: float = 0.4

    def __post_init__(self) -> None:
        if self.min_size < 3 or self.min_sources < 2 or self.delay_hours < 24:
            raise ValueError("published groups need 3 records, 2 sources and 24 hours at least")


TIERS = {0: Limits(min_size=5, delay_hours=72), 1: Limits()}
