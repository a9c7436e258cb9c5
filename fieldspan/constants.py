"""Fixed values of the data model: fields, kinds, document types, labels, months, patterns."""

from __future__ import annotations

# --- Fixed values: they must equal those of the measured systems for results to agree. ---

#: field -> kind, in canonical field order
FIELD_KINDS = {
    "patient_name": "person", "referring_provider_name": "person", "patient_dob": "date", "date_of_service": "date",
    "document_date": "date", "total_charge": "amount", "amount_paid": "amount", "patient_responsibility": "amount",
    "member_id": "reference", "referring_provider_npi": "reference", "document_reference": "reference",
    "servicing_facility": "org", "payer_name": "org", "diagnosis_code": "code", "procedure_code": "code",
}
DOC_TYPES = ["referral_letter", "prior_auth_request", "lab_order", "insurance_claim", "remittance_advice", "patient_intake_form"]
FIELDS_BY_DOCTYPE = {
    "referral_letter": ["patient_name", "patient_dob", "referring_provider_name", "referring_provider_npi", "servicing_facility",
                        "payer_name", "member_id", "document_reference", "document_date", "diagnosis_code"],
    "prior_auth_request": ["patient_name", "patient_dob", "referring_provider_name", "referring_provider_npi", "servicing_facility",
                           "payer_name", "member_id", "document_reference", "document_date", "date_of_service", "diagnosis_code",
                           "procedure_code", "total_charge"],
    "lab_order": ["patient_name", "patient_dob", "referring_provider_name", "referring_provider_npi", "servicing_facility",
                  "document_reference", "document_date", "date_of_service", "diagnosis_code", "procedure_code"],
    "insurance_claim": ["patient_name", "patient_dob", "referring_provider_name", "referring_provider_npi", "servicing_facility",
                        "payer_name", "member_id", "document_reference", "document_date", "date_of_service", "diagnosis_code",
                        "procedure_code", "total_charge"],
    "remittance_advice": ["patient_name", "member_id", "payer_name", "servicing_facility", "document_reference", "document_date",
                          "date_of_service", "procedure_code", "total_charge", "amount_paid", "patient_responsibility"],
    "patient_intake_form": ["patient_name", "patient_dob", "referring_provider_name", "payer_name", "member_id", "document_date"],
}
DOCTYPES_WITH_SERVICE_LINES = ["insurance_claim", "remittance_advice"]
ORG_ROLES = ["referring_org", "servicing_org", "payer_org"]
#: field -> label wording
LABELS = {
    "amount_paid": ["Amount Paid", "Monto Pagado", "Pagado", "Paid", "Insurance Paid", "Amount Allowed"],
    "date_of_service": ["DATE OF SVC", "DOS", "Date of Service", "F. Servicio", "Fecha de Servicio", "Service Date", "Svc Date"],
    "diagnosis_code": ["Código CIE-10", "DX", "Diagnosis", "Diagnosis Code", "Diagnóstico", "Dx Code", "ICD-10"],
    "document_date": ["DATE", "Date", "Date Issued", "Document Date", "Fecha", "Fecha del Documento", "Issued"],
    "document_reference": ["Control #", "Document ID", "N.º de Referencia", "REF", "Ref No.", "Reference #", "Referencia",
                           "Claim Number", "Authorization #", "Order #"],
    "member_id": ["Insurance ID", "MEMBER NO", "Member ID", "N.º de Miembro", "Policy #", "Póliza", "Subscriber ID", "ID Number",
                  "Insured's ID", "Policy Number"],
    "patient_dob": ["BIRTHDATE", "Birth Date", "D.O.B.", "DOB", "Date of Birth", "F. Nac.", "Fecha de Nacimiento", "Birth", "DOB/Sex",
                    "Date of Birth (MM/DD/YYYY)"],
    "patient_name": ["Name of Patient", "Nombre del Paciente", "PATIENT", "PT NAME", "Paciente", "Patient", "Patient Name",
                     "Patient Name(Last, First)", "Insured's Name", "Pt Name"],
    "patient_responsibility": ["Patient Responsibility", "Responsabilidad del Paciente"],
    "payer_name": ["Aseguradora", "Health Plan", "Insurance", "Insurance Carrier", "PAYER", "Payer", "Seguro"],
    "procedure_code": ["CPT", "CPT Code", "Código CPT", "PROC", "Procedimiento", "Procedure", "Procedure Code"],
    "referring_provider_name": ["Médico Remitente", "Ordering Physician", "Proveedor", "Provider", "REFERRING PHYSICIAN", "Referred By",
                                "Referring Provider"],
    "referring_provider_npi": ["NPI", "NPI #", "NPI del Proveedor", "National Provider ID", "Provider NPI", "Referring NPI", "Rendering NPI"],
    "servicing_facility": ["Centro", "Centro de Servicio", "FACILITY NAME", "Facility", "Performing Facility", "Service Location",
                           "Servicing Facility"],
    "total_charge": ["Amount Billed", "CHARGES", "Cargo Total", "Total", "Total Charge", "Total Charges", "Billed Amount", "Total Billed",
                     "Charges"],
}
MONTHS = {
    "jan": 1, "january": 1, "ene": 1, "enero": 1, "feb": 2, "february": 2, "febrero": 2, "mar": 3, "march": 3, "marzo": 3,
    "apr": 4, "april": 4, "abr": 4, "abril": 4, "may": 5, "mayo": 5, "jun": 6, "june": 6, "junio": 6, "jul": 7, "july": 7, "julio": 7,
    "aug": 8, "august": 8, "ago": 8, "agosto": 8, "sep": 9, "sept": 9, "september": 9, "septiembre": 9, "setiembre": 9,
    "oct": 10, "october": 10, "octubre": 10, "nov": 11, "november": 11, "noviembre": 11, "dec": 12, "december": 12, "dic": 12,
    "diciembre": 12,
}
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
NAME_TITLES = r"\b(?:dr|doctor|mr|mrs|ms|miss|prof|sr|sra|srta)\b\.?"
NAME_SUFFIXES = r"\b(?:m\.?d|d\.?o|r\.?n|n\.?p|p\.?a[- ]?c|d\.?d\.?s|ph\.?d|f\.?a\.?c\.?p|jr|sr|ii|iii|iv|esq)\b\.?"
ORG_SUFFIXES = (r"\b(?:inc|llc|l\.l\.c|llp|ltd|limited|corp|corporation|co|company|pc|p\.c|pa|p\.a|plc|group|grp|assoc|associates"
                r"|partners|holdings|sa|s\.a)\b\.?")
MONEY_WORDS = r"\b(?:usd|us\$|dollars?|total|amount|monto|importe)\b"
ICD10 = r"[A-TV-Z][0-9][0-9A-Z](?:\.?[0-9A-Z]{1,4})?"
CPT = r"(?:\d{4}[\dF]|[A-CEG-VX][\d]{4})"
CPT_STRICT = r"(?:\d{5}|[A-CEG-VX]\d{4})"
AMOUNT = r"(?:USD\s*)?\$?\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?"
DATE = (r"\b(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}-\d{2}-\d{2}"
        r"|\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*-\d{2,4}"
        r"|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"
        r"|\d{1,2}\s+de\s+[a-zé]+\s+de\s+\d{4})\b")
MEMBER_ID = r"\b(?:[A-Z]{1,3}\d{6,12}[A-Z]?|\d{3}-\d{2}-\d{4}|\d{9,12})\b"
REFERENCE = r"\b(?:REF|RF|AUTH|PA|ORD|LAB|CLM|CL|EOB|RA)[-\s]?\d{5,9}\b"
#: document type -> words that give it away, in the order in which they are tried
DOCTYPE_WORDS = {
    "remittance_advice": ["explanation of benefits", "remittance", "payment advice", "plan paid", "explicacion de beneficios"],
    "insurance_claim": ["claim form", "cms-1500", "health insurance claim", "reclamacion"],
    "prior_auth_request": ["prior authorization", "pre-authorization", "autorizacion previa"],
    "lab_order": ["laboratory order", "lab requisition", "diagnostic order", "orden de laboratorio"],
    "patient_intake_form": ["intake form", "registration", "patient information", "admision"],
    "referral_letter": ["referral", "referring", "remision", "dear colleague"],
}
#: template -> (layout, columns, label variant)
TEMPLATES = {
    1: ("inline", 1, 0), 2: ("inline", 2, 1), 3: ("below", 2, 0), 4: ("inline", 1, 2), 5: ("grid", 2, 1), 6: ("inline", 2, 3),
    7: ("prose", 1, 0), 8: ("below", 1, 4), 9: ("grid", 3, 2), 10: ("inline", 1, 1), 11: ("grid", 3, 4), 12: ("prose", 1, 2),
    13: ("below", 3, 3), 14: ("grid", 2, 0),
}
TRAIN_TEMPLATES = range(1, 11)
FUZZY_THRESHOLD = 88
USD_PER_MTOK_INPUT, USD_PER_MTOK_OUTPUT, CHARS_PER_TOKEN = 5.0, 25.0, 3.6
