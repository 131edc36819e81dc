"""Column layouts of the input files and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def layout(ddl: str) -> T.StructType:
    pairs = [field.split() for field in ddl.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# FIXED VALUES: delivery-report headers (normalised) every file must have.
REPORT_HEADERS = [
    "transaction_id", "message_id", "mobile", "sender_name", "text_message", "type", "length",
    "cost", "status", "cause", "channel_name", "submitted_time", "delivered_time", "ip",
    "entity_id", "template_id",
]
HEADER_SPELLINGS = {"entityid": "entity_id", "templateid": "template_id"}

# FIXED VALUES: declared widths of the staged columns.
STAGED_WIDTHS = {
    "transaction_id": 20, "message_id": 20, "mobileNo": 12, "sender": 10, "type": 10,
    "length": 5, "cost": 2, "status": 15, "cause": 50, "channel_name": 20, "submit_time": 30,
    "delivered_time": 30, "ip": 10, "entity_id": 20, "template_id": 20, "source": 50,
    "client": 80, "product": 80, "base": 50, "circle": 30, "vendor": 15, "channel": 10,
}

STAGED_COLUMNS = [
    "transaction_id", "message_id", "mobileNo", "sender", "text", "type", "length", "cost",
    "status", "cause", "channel_name", "submit_time", "delivered_time", "ip", "entity_id",
    "template_id", "source", "client", "product", "base", "circle", "vendor", "channel",
]
STAGED = texts(*STAGED_COLUMNS)

# FIXED VALUES: columns of the stored tables, text as received, typed days for pushdown, then the partition columns.
LOG_COLUMNS = [c for c in STAGED_COLUMNS if c not in ("client", "base", "vendor", "channel")]
DND_COLUMNS = ["mobileNo", "status", "date"]
DONE_COLUMNS = [
    "mobileNo", "status", "date", "channel", "sender", "circle", "vendor", "source", "base",
    "product", "client", "cause",
]
PROMO_COLUMNS = [
    "mobileNo", "circle", "vendor", "status", "product", "date", "source", "channel", "cause",
    "sender", "client",
]


def _stored(columns: list[str], day: str, *partitions: str) -> T.StructType:
    s = texts(*columns).add(day, T.DateType())
    for name in partitions:
        s = s.add(name, T.StringType())
    return s


MESSAGE_LOG = _stored(LOG_COLUMNS, "submit_date", "month", "mapping_key")
DND = _stored([*DND_COLUMNS, "source"], "submit_date", "month", "mapping_key")
CAMPAIGN_DONE = _stored(DONE_COLUMNS, "submit_date", "month", "done_key")
PROMOTIONS = _stored(PROMO_COLUMNS, "delivered_date", "month")

LOADS = texts("folder", "key", "source", "month")

MAPPING = layout(
    "id int, sender string, client string, product string, channel string, "
    "mapping string, log_mapping string"
)
REGION = texts("series", "circle")
ERROR_CODES = texts("code", "status", "cause")
CDR = layout(
    "uuId string, msgId string, mobileNo string, senderName string, text string, msgType string, "
    "length string, cost string, globalErrorCode string, submitTime bigint, deliveryTime bigint, "
    "additionalData string, cdr_date date"
)
TEMPLATES = texts("tempid", "sender", "count", "text", "type", "month")
REJECTED = (
    texts("source", "file_path").add("missing", T.ArrayType(T.StringType())).add("reason", T.StringType())
)
LEDGER = layout("date string, filename string, filepath string, uploaded_at timestamp_ntz")

# FIXED VALUES: column order of the lead sheets, by feed and sheet.
FEED_A_LEADS = (
    "report_date phone utm_campaign utm_medium source utm_term product quote_load city "
    "city_category gmb_definition"
).split()
FEED_A_SALES = (
    "report_date phone utm_campaign utm_medium source utm_term product gwp city city_category "
    "amount"
).split()
FEED_B_LEADS = (
    "lead_date data_source reffer_id_source camp_type owner_user_id lead_id lead_status "
    "lead_category camp_name call_status city tg state branch car_model car_make callback_date "
    "lead_position total_no_of_call_attempts fresh_lead first_date last_date verified_flag "
    "verified_by verified_date active_flag last_updated_date remarks created_by not_interested "
    "no_of_call_attempts pincode follow_up not_qualified rejection lead_type control_location "
    "age_group keyword cmp placement event_string gclid gaid web_url whatsapp_consent "
    "consent_date concat_string utm_term family_size lead_score lead_stage nvuid browser_name "
    "browser_platform browser_version"
).split()
FEED_C_LEADS = (
    "offer_id offer_name offer_product business_vertical bv utm_source utm_medium utm_campaign "
    "bt_f utm_content sourcing_branch warm channel city campaign_date month demart_status "
    "vouchers utm_product turnover total_experience tele_followup telecaller_remarks "
    "telecaller_action tele_userid tele_disposition_1 tele_disposition_2 tele_disposition_3 "
    "telecaller_dispositiontype sale_status responsed_date required_loan_amount "
    "property_location property_identified propensity pan_no owner_id owner_name offer_amount "
    "not_salary ndeureofbusiness nameof_degree degree_type loan_type lead_id idest_cibil_mobile "
    "isbt hostleadid gross_receipt field_followup_date field_userid field_remarks "
    "field_disposition_3 field_disposition_2 field_disposition_1 sales_dispositiontype "
    "field_action enquiry_city enquiry_product employment_type email_id dnc_flag customer_name "
    "cibil_notes camp_type camp_name mobile_no alt_mobile_no agreement_no curr_experience "
    "enquiry_datetime requiredloan_amount current_bank_name sanctioned_loan_amount "
    "rate_of_interest interested_in field_last3years property_type down_payment "
    "processing_branch zip_code hold_date hold_reason date_of_birth login_date "
    "tele_disposition_date disp_camp_date log_camp_tde rechurn_bv rechurn_date ok_tag "
    "exclusion_reason allocated_ownerid fcc present_ownerid priority bhfl_bfl field flag "
    "rechurn_flag p2_flag_field rechurn_field ticket_size"
).split()
FEED_C_STAGE = (
    "login_agreementno bussiness_vertical bv customer_id login_date month initiate_login_date "
    "approval_date colletral_date sourchannel_category loan_login_status revised_stage wip "
    "lead_pan lead_mobile_no lead_altmobile_no phn_no datamart_altmobile_no co_applicant1_phn "
    "co_applicant2_phn co_applicant3_phn pan_c co_applicant1_pancard co_applicant2_pancard "
    "co_applicant3_pancard login_status approved_loan_amount total_loan_amount loan_category "
    "product_code lead_source cust_cif disbursement_date branch_id city_name lead_id offer_id "
    "camp_type camp_name camp_date utm_source utm_medium utm_campaign utm_content utm_product "
    "offer_date offer_name offer_product product_offering_name owner_id datamart_status "
    "offer_amount po_business_vertical bt camp_tat vouchers response_type channel "
    "dispositionvl1_sales dispositionvl2_sales dispositionvl3_sales sales_status "
    "dispositionvl1_telecaller dispositionvl2_telecaller dispositionvl3_telecaller "
    "telecaller_dispositiontype tat flag initiate_login_tat initiate_login_flag lead_reference "
    "match_flag business_vertical_flag initiate_login_calc_tat calc_tat score cnt fcc"
).split()

FEEDS = {
    ("A", "leads"): FEED_A_LEADS,
    ("A", "sales"): FEED_A_SALES,
    ("B", "leads"): FEED_B_LEADS,
    ("C", "leads"): FEED_C_LEADS,
    ("C", "login"): FEED_C_STAGE,
    ("C", "approval"): FEED_C_STAGE,
    ("C", "disbursal"): FEED_C_STAGE,
}

# FIXED VALUES: position of each sheet in its workbook.
SHEETS = {
    "A": {"leads": 0, "sales": 1},
    "B": {"leads": 0, "sales": 1},
    "C": {"leads": 1, "login": 2, "approval": 3, "disbursal": 4},
}

# FIXED VALUES: date columns of each sheet.
ISO_DAYS = {("A", "leads"): ["report_date"], ("A", "sales"): ["report_date"]}
NAMED_DAYS = {("B", "leads"): ["lead_date"]}
SECONDS = {("B", "leads"): ["first_date", "last_date", "last_updated_date", "consent_date"]}
US_DAYS = {
    ("C", "leads"): [
        "campaign_date", "responsed_date", "field_followup_date", "date_of_birth", "login_date",
        "tele_disposition_date",
    ],
    ("C", "login"): ["login_date", "initiate_login_date", "camp_date", "offer_date"],
    ("C", "approval"): ["login_date", "initiate_login_date", "camp_date", "offer_date"],
    ("C", "disbursal"): ["login_date", "initiate_login_date", "camp_date", "offer_date"],
}
DECIMALS = {("A", "sales"): ["gwp", "amount"]}

# FIXED VALUES: the key a feed row is known by.
FEED_KEYS = {
    ("B", "leads"): "lead_id",
    ("C", "leads"): "offer_id",
    ("C", "login"): "customer_id",
    ("C", "approval"): "customer_id",
    ("C", "disbursal"): "customer_id",
}
