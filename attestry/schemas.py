"""Column schemas of the landed documents and derived tables."""

from __future__ import annotations

PHONE = "struct<id:bigint,number:string,service_type:string,country_code:string>"
ADDRESS = "struct<address_1:string,city:string,state_province:string,postal_code:string>"
CATEGORY = "struct<id:bigint,name:string>"
_PROSE = (
    "long_description:string,short_description:string,application_process:string,"
    "required_documents:string,fee:string,wait_time:string,"
    "interpretation_services:string,notes:string"
)
SERVICE = (
    f"struct<id:bigint,name:string,categories:array<{CATEGORY}>,"
    f"eligibilities:array<struct<name:string>>,{_PROSE}>"
)
SCHEDULE = (
    "struct<hours_known:boolean,schedule_days:array<"
    "struct<day:string,opens_at:int,closes_at:int>>>"
)
_LISTING_FIELDS = (
    "id:bigint,name:string,status:string,website:string,email:string,verified_at:string,"
    "certified_at:string,certified:boolean,updated_at:string,service_edit_url:string,"
    f"phones:array<{PHONE}>,addresses:array<{ADDRESS}>,categories:array<{CATEGORY}>,"
    f"services:array<{SERVICE}>,schedule:{SCHEDULE},eligibilities:string,{_PROSE}"
)
LISTING = f"struct<{_LISTING_FIELDS}>"
# A landed file holds the listing itself or wraps it in {"resource": ...}.
LANDED = f"struct<resource:{LISTING},{_LISTING_FIELDS},_corrupt_record:string>"
WORK_LIST = (
    "service_id", "service_name", "resource_id", "resource_name", "resource_website",
    "service_edit_url", "service_updated_at",
)
FINDING = (
    "struct<field:string,stored:string,live:string,evidence_url:string,"
    "evidence_quote:string,match:boolean,structural:boolean,phone_id:bigint,"
    "proposed:string>"
)
CHANGE_REQUEST = (
    "struct<field:string,current:string,proposed:string,source_url:string,"
    "source_quote:string,listing_url:string,listing_edit_url:string,org_website:string,"
    "submitted_by:string,structural:boolean>"
)
RAW_REVIEW = (
    "resource_id string, name string, verdict string, reason string, confidence double, "
    "fetched array<string>, org_website string, listing_url string, "
    "listing_edit_url string, structural boolean, priority double, "
    "blast_size bigint, blast_services array<string>, "
    f"fields array<{FINDING}>, change_request {CHANGE_REQUEST}"
)
DECISION = (
    "resource_id string, name string, field string, action string, decision string, "
    "agent_verdict string, agent_confidence double, blast_radius_size int, "
    "decided_by string, decided_via string, decided_at timestamp, submitted boolean, "
    "stored_value string, note string"
)
