"""Business rules: ages, contract limits, service labels, month names, sentinels."""

from dataclasses import dataclass

# --- fixed values ---

MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

NULL_TOKENS = ("None", "nan", "NaT")
SAP_SENTINELS = ("#N/D", "#N/A")
SAP_SENTINEL_ANY_CASE = "error"

DEFAULT_PROJECT = "Staff"
DEFAULT_SERVICE = "Personal_Interno"
DEFAULT_UNIVERSITY = "POR DEFINIR"
INTERN_CONTRACT = "TERMINO DE CONVENIO"
PROFESSIONAL_INTERN = "PRACTICANTE PROFESIONAL"

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 30.44
EXCEL_EPOCH = "1899-12-30"
FOOTER_LENGTH = 20
DOCUMENT_WORDS = ("NUMERO", "DOC")
PERIOD_PATTERN = r"\d{4}-\d{2}"
# Contract types that have no alert for their length, besides those of interns.
NO_CONTRACT_ALERT = ("PLAZO INDETERMINADO", "CONTRATO EXTRANJERO")
# "About equal": the source's config gives no figure; amounts have two decimals.
NET_TOLERANCE = 0.05
BLANK_RUN = 1000
REASON_SEPARATOR = " | "


@dataclass(frozen=True)
class AgeRule:
    column: str
    age: int
    year_offset: int


@dataclass(frozen=True)
class ContractRule:
    column: str
    modality: str
    alert_years: float


@dataclass(frozen=True)
class TermRule:
    column: str
    low_days: int
    high_days: int | None


AGE_RULES = (
    AgeRule("cumple_65_esteaño", 65, 0),
    AgeRule("cumple_65_proximoaño", 65, 1),
    AgeRule("cumple_70_esteaño", 70, 0),
    AgeRule("cumple_70_proximoaño", 70, 1),
)

CONTRACT_RULES = (
    ContractRule("alerta_contrato_obra", "CONTRATO POR OBRA O SERVICIO ESPECIFICO", 4.5),
    ContractRule("alerta_contrato_incremento", "CONTRATO POR INCREMENTO DE ACTIVIDAD", 2.5),
)

TERM_RULES = (
    TermRule("por_cumplir_1", 335, 364),
    TermRule("cumplio_1", 365, None),
    TermRule("por_cumplir_2", 640, 729),
)
