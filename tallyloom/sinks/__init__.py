"""Writers of run artefacts and of what may be published."""
