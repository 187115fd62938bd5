"""Schemas of the control tables and of the sales tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Column names and types of the tables users already have.
CONTROL_FIELDS = {
    "resource_id": "string",
    "job_name": "string",
    "task_key": "string",
    "depends_on": "string",
    "task_type": "string",
    "job_config": "string",
    "task_config": "string",
    "disabled": "boolean",
    "created_by": "string",
    "created_timestamp": "timestamp",
    "updated_by": "string",
    "updated_timestamp": "timestamp",
}
ID_MAP_FIELDS = {
    "resource_id": "string",
    "job_id": "bigint",
    "job_name": "string",
    "created_by": "string",
    "created_timestamp": "timestamp",
    "updated_by": "string",
    "updated_timestamp": "timestamp",
}
BRONZE_SALES_FIELDS = {
    "order_id": "string",
    "customer_id": "string",
    "product_id": "string",
    "order_date": "date",
    "quantity": "int",
    "unit_price": "decimal(10,2)",
    "revenue": "decimal(12,2)",
    "status": "string",
    "processed_at": "timestamp",
}
CUSTOMER_FIELDS = {
    "customer_id": "string",
    "first_name": "string",
    "last_name": "string",
    "email": "string",
    "registration_date": "string",
    "status": "string",
}
CONTROL_KEYS = ("resource_id", "task_key")


def schema(fields: dict[str, str]) -> StructType:
    result = StructType()
    for name, kind in fields.items():
        result = result.add(name, {"bigint": "long", "int": "integer"}.get(kind, kind))
    return result


CONTROL = schema(CONTROL_FIELDS)
ID_MAP = schema(ID_MAP_FIELDS)
BRONZE_SALES = schema(BRONZE_SALES_FIELDS)
SILVER_SALES = schema({**BRONZE_SALES_FIELDS, "updated_at": "timestamp"})
CUSTOMER = schema(CUSTOMER_FIELDS)
