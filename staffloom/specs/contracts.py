"""Source contracts: file names, sheets, header positions and required headers."""

from staffloom.specs.model import SheetContract, SourceContract

# --- fixed values: published file-name patterns and header positions ---

EMPLOYEE_FILE = r"(?i)^BD\.\s*(\d{2}\.\d{2}\.\d{4})\.\.(xlsx|xlsm|xls)$"
INTERN_FILE = r"(?i)^BD Practicantes\s+(\d{2}\.\d{2}\.\d{4})\.(xlsx|xlsm|xls)$"
MINING_FILE = r"(?i)^.*(?:19|20)\d{2}-\d{2}.*\.(xlsx|xlsm|xls)$"

EMPLOYEES = SourceContract(
    "employees",
    (
        SheetContract(
            "METSO", 10, 0,
            ("NUMERO DE DOC", "CODIGO SAP2", "NOMBRE COMPLETOS", "GERENCIA", "SEXO", "SEDE3",
             "WHITE COLLAR / BLUE COLLAR", "Modalidad de Contrato", "Fecha de Termino", "SERVICIO",
             "REGIMEN DE TRABAJO", "FECH_INGR.", "FECHA DE NAC."),
        ),
    ),
    filename_regex=EMPLOYEE_FILE,
    document_date=True,
)

INTERNS = SourceContract(
    "interns",
    (
        SheetContract(
            "Practicantes", 4, 0,
            ("N°", "DNI", "APELLIDOS Y NOMBRES", "CONDICION", "FECHA ING", "F. RENOVACION", "SEDE",
             "UNIVERSIDAD", "JEFE INMEDIATO", "GERENCIA"),
        ),
    ),
    filename_regex=INTERN_FILE,
    document_date=True,
)

EXIT_EXAMS = SourceContract(
    "exit_exams",
    (SheetContract("DATA", 3, 0, ("NOMBRE", "DNI", "FECHA DE CESE")),),
)

INCOME = SourceContract(
    "income",
    (
        SheetContract("EMPLEADOS", 2, 1, ("AÑO", "MES", "DNI", "N° DOCUM.")),
        SheetContract("PRACTICANTES", 2, 0, ("AÑO", "MES", "Numero Documento")),
    ),
)

LEAVE = SourceContract(
    "leave",
    (
        SheetContract(
            "LICENCIA CON GOCE", 2, 0,
            ("PERIODO", "DNI/CEX", "APELLIDO PATERNO", "APELLIDO MATERNO", "NOMBRES",
             "MOTIVO DE LIC.CON GOCE"),
        ),
        SheetContract(
            "LICENCIA SIN GOCE", 2, 0,
            ("PERIODO", "DNI/CEX", "APELLIDO PATERNO", "APELLIDO MATERNO", "NOMBRES",
             "MOTIVO DE LIC.S.G.H"),
        ),
    ),
)

PAYROLL = SourceContract(
    "payroll",
    (SheetContract("Planilla", 6, 0, ("APELLIDO PATERNO", "NOMBRES", "TIPO DE DOCUMENTO", "DNI/CEX")),),
)

MINING_PAYROLL = SourceContract(
    "mining_payroll",
    (SheetContract("Planilla", 6, 0, ("DNI/CEX",)),),
    filename_regex=MINING_FILE,
)

# Leave type of each leave sheet.
LEAVE_TYPES = {"LICENCIA CON GOCE": "CON_GOCE", "LICENCIA SIN GOCE": "SIN_GOCE"}

# Files that are never a payroll source: lock files and an earlier consolidated output.
PAYROLL_EXCLUDED = ("~$", "Planilla Metso Consolidado")
