"""Declared schemas of the tables the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

STRING, LONG, INTEGER, DOUBLE = StringType(), LongType(), IntegerType(), DoubleType()
TIME = TimestampNTZType()


def _table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, StructType] = {
    "dispense": _table(
        PatPharmSysID=STRING,
        OriginalScriptNumber=STRING,
        ScriptNo=LONG,
        Drugname=STRING,
        BrandName=STRING,
        DrugSchedule=STRING,
        StoreId=INTEGER,
        TotalRepeats=INTEGER,
        RepeatNo=INTEGER,
        DispensedDate=TIME,
        DatePrescribed=TIME,
        DrugVal=STRING,
        PatientPrice=DOUBLE,
    ),
    "stores": _table(
        PharmacyID=INTEGER,
        CommercialName=STRING,
        TimeZoneState=STRING,
        ExcludeHC=INTEGER,
        BIRExtractionFlag=INTEGER,
        ContactPerson1=STRING,
        ContactPerson2=STRING,
        ContactNumber=STRING,
        PharmacyGroupId=STRING,
        CommentsHC=STRING,
        BestContactTime=STRING,
        UpdatedDate=TIME,
        IsActive=INTEGER,
    ),
    "patients": _table(
        dispenseid=STRING,
        storeid=LONG,
        gender=STRING,
    ),
    "contacts": _table(
        id=LONG,
        patientid=STRING,
        storeid=LONG,
        contactemail=STRING,
        created_at=TIME,
        updated_at=TIME,
    ),
    "errors": _table(
        PharmacyId=STRING,
        ErrorID=LONG,
        ErrorIndicator=STRING,
        ErrorTypeUDC=STRING,
        ErrorSource=STRING,
        ErrorMessage=STRING,
        StepUDC=STRING,
        TableName=STRING,
        ErrorDate=TIME,
    ),
    "pings": _table(
        StoreId=INTEGER,
        ping=TIME,
    ),
    "users": _table(
        Userid=LONG,
        Username=STRING,
        Email=STRING,
        Firstname=STRING,
        Lastname=STRING,
        Status=STRING,
        StatusUDC=STRING,
        IsSuperAdmin=INTEGER,
        RoleID=INTEGER,
        CreatedDate=TIME,
        UpdatedDate=TIME,
    ),
    "roles": _table(
        RoleID=INTEGER,
        RoleName=STRING,
        RoleDescription=STRING,
        IsActive=INTEGER,
    ),
    "permissions": _table(
        PermissionID=INTEGER,
        PermissionName=STRING,
        PermissionDescription=STRING,
        Module=STRING,
        IsActive=INTEGER,
    ),
    "role_permissions": _table(
        RoleID=INTEGER,
        PermissionID=INTEGER,
        IsActive=INTEGER,
    ),
    "messages": _table(
        conv_id=LONG,
        turn=LONG,
        message=STRING,
    ),
    "sales": _table(
        StoreId=STRING,
        SalesDate=TIME,
    ),
    "stock": _table(
        StoreId=STRING,
        StockID=LONG,
    ),
    "ean_links": _table(
        StoreId=STRING,
        EAN=LONG,
    ),
    "wh_patients": _table(
        StoreId=STRING,
        PatientId=LONG,
    ),
    "dispense_transactions": _table(
        StoreId=STRING,
        PatPharmSysID=STRING,
        DispensedDate=TIME,
        ScriptNo=LONG,
        Drugname=STRING,
    ),
}

# Tables of the sales and stock warehouse; all others belong to the configuration database.
WAREHOUSE_TABLES = ("sales", "stock", "ean_links", "wh_patients", "dispense_transactions")


def conform(df: DataFrame, schema: StructType, name: str = "table") -> DataFrame:
    """The declared columns in the declared types and order.

    A missing column is an error. A column of another type is cast, which fails
    on the first value that does not fit.
    """
    missing = [field.name for field in schema if field.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    actual = df.schema
    return df.select(
        *[
            F.col(field.name)
            if actual[field.name].dataType == field.dataType
            else F.col(field.name).cast(field.dataType).alias(field.name)
            for field in schema
        ]
    )
