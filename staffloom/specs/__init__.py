from staffloom.specs.model import Col, RowFilter, SheetContract, SourceContract, TableSpec

__all__ = ["Col", "RowFilter", "SheetContract", "SourceContract", "TableSpec"]
