from strata.sources.tables import Tables, load_tables, program_tables, driver_tables, register_views

__all__ = ["Tables", "load_tables", "program_tables", "driver_tables", "register_views"]
