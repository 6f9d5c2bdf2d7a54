"""What each vendor's sensor reports for each class of telemetry."""

NOTE = "Representative sensor telemetry by event class. Names vary by sensor version, platform and configuration; validate against your own tenant. A value in brackets means the sensor has no event of its own for that class."

VENDORS = {"crowdstrike": "CrowdStrike Falcon", "defender": "Microsoft Defender for Endpoint", "sentinelone": "SentinelOne", "elastic": "Elastic Defend"}

ALIASES = {"falcon": "crowdstrike", "cs": "crowdstrike", "mde": "defender", "msde": "defender", "s1": "sentinelone", "elastic-defend": "elastic"}

# class: events of crowdstrike, defender, sentinelone, elastic
EVENTS = {
    "process_creation": (["ProcessRollup2", "SyntheticProcessRollup2"], ["DeviceProcessEvents"], ["Process Creation"], ["process (event.type:start)"]),
    "network_connection": (["NetworkConnectIP4", "NetworkReceiveAcceptIP4"], ["DeviceNetworkEvents"], ["IP Connect", "IP Listen"], ["network (event.type:connection)"]),
    "file_write": (["NewExecutableWritten", "NewScriptWritten"], ["DeviceFileEvents"], ["File Creation", "File Modification"], ["file (event.type:creation)"]),
    "file_access": (["(reads surface via ProcessRollup2 of the accessing process)"], ["DeviceFileEvents (sensitive-file access)"], ["File Scan"], ["file (event.type:access)"]),
    "image_load": (["ClassifiedModuleLoad", "DriverLoad"], ["DeviceImageLoadEvents"], ["Module Load"], ["library (event.type:start)", "driver"]),
    "registry_set": (["AsepValueUpdate"], ["DeviceRegistryEvents"], ["Registry Value Modified"], ["registry (event.type:change)"]),
    "process_access": (["(credential-access detection; ProcessRollup2 of the accessing process)"], ["DeviceEvents (ActionType OpenProcessApiCall)"], ["Cross-Process (open process handle)"], ["process (event.action:process_access)"]),
    "scheduled_task": (["(surfaces via ProcessRollup2 of the scheduler + registry/file writes)"], ["DeviceEvents (ActionType ScheduledTaskCreated)"], ["Scheduled Task Register"], ["(process + file/registry writes)"]),
    "service_change": (["(surfaces via registry ASEP + ProcessRollup2)"], ["DeviceEvents (ActionType ServiceInstalled)"], ["(service via registry / process)"], ["(process + registry writes)"]),
    "ps_script": (["ScriptControlScanTelemetry", "CommandHistory"], ["DeviceEvents (ActionType PowerShellCommand)"], ["Command Script"], ["process (PowerShell script block)"]),
    "authentication": (["UserLogon", "UserLogoff"], ["DeviceLogonEvents"], ["Login", "Logout"], ["authentication"]),
    "log_clear": (["(no dedicated event; ProcessRollup2 of the clearing tool)"], ["DeviceEvents (ActionType SecurityLogCleared)"], ["(process context of the clearing tool)"], ["process (wevtutil / journalctl / log)"]),
    "permission_change": (["(surfaces via ProcessRollup2 of chmod / chattr / chflags)"], ["DeviceProcessEvents", "DeviceFileEvents"], ["Process Creation"], ["process", "file"]),
}
