"""webwarden.plans"""
