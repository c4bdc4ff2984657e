"""Column expressions shared by the operators; nothing here triggers a job."""
