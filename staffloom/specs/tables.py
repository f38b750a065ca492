"""Typed table specs of the eight datasets."""

from staffloom.specs import rules
from staffloom.specs.model import Col, RowFilter, TableSpec
from staffloom.specs.row_rules import After, Balance, NotNegative, OneOf, OnlyWith, Pattern, WithinPeriod

# --- fixed values: column names, types and limits of the published tables ---

EMPLOYEES = TableSpec(
    "employees",
    (
        Col("NUMERO DE DOC", required=True),
        Col("CODIGO SAP2", required=True),
        Col("NOMBRE COMPLETOS", required=True),
        Col("GERENCIA", required=True),
        Col("SEXO", required=True),
        Col("SEDE3", required=True),
        Col("WHITE COLLAR / BLUE COLLAR", required=True),
        Col("Modalidad de Contrato", required=True),
        Col("Fecha de Termino", "date", required=True),
        Col("SERVICIO", required=True),
        Col("REGIMEN DE TRABAJO", required=True),
        Col("FECH_INGR.", "date", required=True),
        Col("FECHA DE NAC.", "date", required=True),
        Col("FECHA_DOCUMENTO", required=True),
    ),
    primary_key=("NUMERO DE DOC",),
    row_rules=(
        After("Fecha de Termino", "FECH_INGR."),
        OneOf("Modalidad de Contrato", (*[r.modality for r in rules.CONTRACT_RULES], *rules.NO_CONTRACT_ALERT), (rules.INTERN_CONTRACT,)),
    ),
)

COST_CENTERS = TableSpec(
    "cost_centers",
    (
        Col("CC", required=True),
        Col("NOMBRE CC", required=True),
        Col("CATEGORIA CC", required=True),
        Col("GERENCIA", required=True),
    ),
    primary_key=("CC",),
)

PAYROLL = TableSpec(
    "payroll",
    (
        Col("PERIODO", nullable=False),
        Col("AÑO", nullable=False),
        Col("MES", "integer", nullable=False, min_value=1, max_value=12),
        Col("CÓDIGO CORPORATIVO"),
        Col("APELLIDO PATERNO", nullable=False),
        Col("APELLIDO MATERNO"),
        Col("NOMBRES", nullable=False),
        Col("TIPO DE DOCUMENTO", nullable=False),
        Col("DNI/CEX", nullable=False),
        Col("SEXO", allowed=("M", "F")),
        Col("F. NACIMIENTO", "date"),
        Col("ÁREA"),
        Col("CENTRO DE COSTOS"),
        Col("FECHA DE INGRESO", "date"),
        Col("FECHA CESE", "date"),
        Col("MOTIVO CESE"),
        Col("DIAS SUBSIDIO ENFERMEDAD", "integer", min_value=0),
        Col("DIAS GOCE HABER(D)", "integer", min_value=0),
        Col("# HRS EXTRAS SIMP.25%", "float", min_value=0),
        Col("# HRS EXTRAS SIMP.35%", "float", min_value=0),
        Col("#HRS EXTRAS DOBLES", "float", min_value=0),
        Col("#HRS SIMP.50%", "float", min_value=0),
        Col("HRS SIMPLES AL 50%", "float", min_value=0),
        Col("HORAS EXTRAS 25%", "float", min_value=0),
        Col("HORAS EXTRAS 35%", "float", min_value=0),
        Col("HORAS EXTRAS 100%", "float", min_value=0),
        Col("LICENCIA GOCE HABER", "float", min_value=0),
        Col("DIAS DIST.LIC.S.GH", "integer", min_value=0),
        Col("SUBS. POR ENFERMEDAD", "float", min_value=0),
        Col("SUBS. POR ACCIDENTE", "float", min_value=0),
    ),
    primary_key=("PERIODO", "DNI/CEX"),
    row_rules=(
        After("FECHA CESE", "FECHA DE INGRESO"),
        OnlyWith("MOTIVO CESE", "FECHA CESE"),
        Pattern("PERIODO", rules.PERIOD_PATTERN),
    ),
)

MINING_PAYROLL = TableSpec(
    "mining_payroll",
    (
        Col("PERIODO", nullable=False),
        Col("MES", "integer", nullable=False, min_value=1, max_value=12),
        Col("AÑO", nullable=False),
        Col("CÓDIGO CORPORATIVO"),
        Col("DNI/CEX", nullable=False),
        Col("SEXO", allowed=("M", "F")),
        Col("F. NACIMIENTO", "date"),
        Col("PUESTO"),
        Col("SEDE"),
        Col("ÁREA"),
        Col("CENTRO DE COSTOS"),
        Col("DESC. CENTRO DE COSTO"),
        Col("FECHA DE INGRESO", "date"),
        Col("DIAS TRABAJADOS", "integer", min_value=0, max_value=31),
        Col("DIAS DESC MEDICO (P)", "float", min_value=0),
        Col("# HRS EXTRAS SIMP.25%", "float", min_value=0),
        Col("# HRS EXTRAS SIMP.35%", "float", min_value=0),
        Col("HORAS EXTRAS 25%", "float", min_value=0),
        Col("HORAS EXTRAS 35%", "float", min_value=0),
        Col("#HRS EXTRAS DOBLES", "float", min_value=0),
        Col("HORAS EXTRAS 100%", "float", min_value=0),
        Col("DESCANSO MEDICO", "float", min_value=0),
        Col("TOTAL INGRESOS", "float", min_value=0),
        Col("TOTAL DESCUENTOS", "float", min_value=0),
        Col("TOTAL APORTACIONES", "float", min_value=0),
        Col("NETO", "float"),
    ),
    primary_key=("PERIODO", "DNI/CEX"),
    row_rules=(
        Balance("NETO", "TOTAL INGRESOS", "TOTAL DESCUENTOS", rules.NET_TOLERANCE),
        NotNegative("NETO"),
        WithinPeriod("FECHA DE INGRESO", "PERIODO"),
        Pattern("PERIODO", rules.PERIOD_PATTERN),
    ),
)

LEAVE = TableSpec(
    "leave",
    (
        Col("PERIODO", nullable=False),
        Col("DNI/CEX", nullable=False),
        Col("APELLIDO PATERNO", nullable=False),
        Col("APELLIDO MATERNO", nullable=False),
        Col("NOMBRES", nullable=False),
        Col("MOTIVO", nullable=False),
        Col("TIPO_LICENCIA", nullable=False, allowed=("CON_GOCE", "SIN_GOCE")),
    ),
    renames={"MOTIVO DE LIC.CON GOCE": "MOTIVO", "MOTIVO DE LIC.S.G.H": "MOTIVO"},
)

INCOME_EMPLOYEES = TableSpec(
    "income_employees",
    (
        Col("PERIODO", nullable=False),
        Col("AÑO", "integer", nullable=False, min_value=2020),
        Col("MES", "integer", nullable=False, min_value=1, max_value=12),
        Col("DNI", nullable=False),
        Col("N° DOCUM.", nullable=False),
        Col("FECHA NACIMIENTO", "date"),
        Col("SEXO", allowed=("M", "F")),
        Col("DEPARTAMENTO"),
        Col("PROVINCIA"),
        Col("DISTRITO"),
        Col("CARGO"),
        Col("ÁREA"),
        Col("LUGAR DE TRABAJO"),
        Col("FECHA INICIO", "date"),
        Col("WC/BC"),
        Col("Tiempo de contrato"),
        Col("SERVICIO", nullable=False),
        Col("REGIMEN", nullable=False),
    ),
    primary_key=("PERIODO", "DNI"),
    row_rules=(Pattern("PERIODO", rules.PERIOD_PATTERN),),
)

INCOME_INTERNS = TableSpec(
    "income_interns",
    (
        Col("PERIODO", nullable=False),
        Col("AÑO", "integer", nullable=False, min_value=2020),
        Col("MES", "integer", nullable=False, min_value=1, max_value=12),
        Col("Numero Documento", nullable=False),
        Col("Sexo", allowed=("M", "F")),
        Col("Cargo"),
        Col("Área"),
        Col("Jefe Directo"),
        Col("Lugar de Trabajo"),
        Col("Universidad de Procedencia"),
        Col("Modalidad"),
    ),
    primary_key=("PERIODO", "Numero Documento"),
    row_rules=(Pattern("PERIODO", rules.PERIOD_PATTERN),),
)

INTERN_CONTROL = TableSpec(
    "intern_control",
    (
        Col("N°", required=True),
        Col("DNI", required=True),
        Col("APELLIDOS Y NOMBRES", required=True),
        Col("CONDICION", required=True),
        Col("FECHA ING", "date", required=True),
        Col("F. RENOVACION", "date", required=True),
        Col("SEDE", required=True),
        Col("UNIVERSIDAD", required=True),
        Col("JEFE INMEDIATO", required=True),
        Col("GERENCIA", required=True),
    ),
)

EXIT_EXAMS = TableSpec(
    "exit_exams",
    (
        Col("NOMBRE", nullable=False),
        Col("DNI", nullable=False),
        Col("FECHA DE CESE", "date", nullable=False),
        Col("CAUSA DE SALIDA"),
        Col("CARGO"),
        Col("NOMBRE DE CC"),
        Col("AÑO", "integer", nullable=False, derived_from="FECHA DE CESE"),
        Col("MES", "integer", nullable=False, min_value=1, max_value=12, derived_from="FECHA DE CESE"),
        Col("NOMBRE_MES", derived_from="FECHA DE CESE"),
    ),
    primary_key=("DNI", "FECHA DE CESE"),
    filters=(RowFilter("CARGO", "NOT_EQUAL", "STUDENT INTERNAL"),),
)

# Date columns of the raw exit-exam sheet.
EXIT_EXAM_DATES = (
    "F. NACIMIENTO",
    "FECHA DE CESE",
    "UTLIMA FECHA PARA EXAMEN MEDICO",
    "2DA CONVOCATORIA EXAMEN MEDICO",
)

# Headers of the two income sheets, in sheet order.
INCOME_EMPLOYEE_HEADERS = (
    "AÑO", "MES", "DNI", "N° DOCUM.", "NOMBRES COMPLETOS", "SEXO", "DEPARTAMENTO", "PROVINCIA",
    "DISTRITO", "CARGO", "ÁREA", "JEFE DIRECTO", "LUGAR DE TRABAJO", "FECHA INICIO", "CC", "WC/BC",
    "Tiempo de contrato", "NIVEL II", "NIVEL III", "NIVEL IV", "PROYECTO", "CODIGO SAP",
)
INCOME_INTERN_HEADERS = (
    "AÑO", "MES", "Tipo Documento", "Numero Documento", "CODIGO SAP", "Nombres Completos",
    "Fecha Nacimiento", "Sexo", "Departamento", "Provincia", "Distrito", "Nacionalidad", "Cargo",
    "Área", "Jefe responsable de área", "Sede de Trabajo", "Fecha Inicio", "CC", "Teléfono",
    "Universidad de Procedencia",
)
