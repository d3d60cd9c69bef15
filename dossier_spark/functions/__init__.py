"""Part of dossier_spark."""
