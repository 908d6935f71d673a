"""Reading tables and writing forecasts."""
