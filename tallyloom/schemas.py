"""Column lists of the exchange formats and of the person record."""

# Headers of the two import layouts and of the person record.
PUBLIC_COLUMNS = ["id", "last_name", "first_name", "middle_name", "extension_name", "region", "province", "city_municipality", "barangay", "contact_no", "month_mm", "day_dd", "year_yyyy", "sex"]
LEGACY_COLUMNS = ["generated_id", "last_name", "first_name", "middle_name", "extension_name", "sex", "birthdate_iso", "region_code", "province_code", "city_code", "barangay_code", "contact_no"]
PERSON_COLUMNS = [
    "internal_uuid", "generated_id", "last_name", "first_name", "middle_name", "extension_name", "norm_last_name", "norm_first_name", "norm_middle_name", "norm_extension_name",
    "region_code", "region_name", "province_code", "province_name", "city_code", "city_name", "barangay_code", "barangay_name", "contact_no", "contact_no_norm",
    "birth_month", "birth_day", "birth_year", "birthdate_iso", "sex", "record_status", "duplicate_status", "source_type", "source_reference", "created_at", "updated_at", "deleted_at",
]
