"""Writers: bucketed results, delivery, export, audit log, descriptions."""
