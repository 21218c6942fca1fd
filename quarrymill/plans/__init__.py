"""quarrymill.plans"""
