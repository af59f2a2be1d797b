"""Operators over the declaration tables.

`t` is any object with the tables as DataFrame attributes: documents,
facilities, facility_years, form_compliance and so on (see yearbook.schema).
"""
